import random

import pytest

WORDS = "the of and shore river stone bright walks under table seven cold maple quiet letter garden engine".split()
SCHEMA = "doc_id BIGINT, text STRING, kept BOOLEAN, tail STRING, n INT, part STRING, _id STRING, score STRING, rest STRING"


def prose(seed, n):
    """n words of text without structure, a line feed now and then."""
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + str(r.randrange(40)) + r.choice([" ", " ", " ", " ", "\n"]) for _ in range(n))


def thue_morse(n):
    """Two words of n letters that every polynomial hash modulo a power of two takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, True, "x", 1, "y", "z", "s", "r") for i, t in rows], SCHEMA)


@pytest.fixture
def awkward(spark):
    """Null and repeated ids, null, empty, blank, short, very long and repeated texts."""
    a, b = prose(1, 80), prose(2, 90)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, a), (6, a), (7, a + " end"), (8, b), (8, b),
        (9, prose(3, 60)), (9, prose(4, 60)), (None, a), (None, prose(5, 50)), (10, prose(6, 30000)), (11, "é ß 　 日本"),
    ]
    return rows, frame(spark, rows)


@pytest.fixture
def empty(spark):
    return frame(spark, [])
