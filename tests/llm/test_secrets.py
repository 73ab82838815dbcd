import random
import re
import string

import pytest

from areaweave.llm import secrets as S
from tests.llm.conftest import frame, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


CASES = [
    None, "", "nothing here", "password=short", "PassWord = 'abcdefghijkl'", "token=password=abcdefghijklmn",
    "secret=token: abcdefghijklmnop", "é日 api_key: ABCDEFGHIJKLMNOP and AKIAABCDEFGHIJKLMN then deadbeefdeadbeef00",
    "AKIAAKIAAKIA1", "0123456789abcdef" * 3, "passwd\"  :  \"x.y_z-1234567890==", "a" * 5000, "token='abcdef012345' token='abcdef012345'",
    "\U0001f600 secret=aaaaaaaaaaaaaaaaaaaa",
]


def base(row):
    return [tuple(s) for s in row.spans if s.kind < 3]


def test_base_spans_match_brute_force(spark):
    rows = list(enumerate(CASES))
    for row in S.find_secrets(frame(spark, rows)).collect():
        assert base(row) == brute(CASES[row.doc_id])


def test_random_strings_are_found_and_text_is_not(spark):
    r = random.Random(3)
    make = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    rows = []
    for i in range(120):
        if i % 3 == 0:
            rows.append((i, f"x {make(44, string.ascii_letters + string.digits + '+/')} y"))
        else:
            rows.append((i, f"see production-server-0{i % 10}-eu-west and chapter{i}section{i}paragraph {prose(i, 20)}"))
    found = S.find_secrets(frame(spark, rows)).collect()
    hits = {row.doc_id for row in found if any(s.kind == 3 for s in row.spans)}
    truth = {i for i, _ in rows if i % 3 == 0}
    assert len(hits & truth) >= 0.9 * len(truth) and len(hits - truth) <= 1


def test_random_strings_without_digits_are_found(spark):
    r = random.Random(8)
    rows = []
    for i in range(90):
        key = "".join(r.choice(string.ascii_letters + "+/") for _ in range(32))
        word = ("internationalization", "telecommunications", "well-known-and-often-used", "x" * 300, "A" * 200)[i % 5]
        rows.append((i, f"x {key if i % 3 == 0 else word} {prose(i, 20)}"))
    found = S.find_secrets(frame(spark, rows)).collect()
    hits = {row.doc_id for row in found if any(s.kind == 3 for s in row.spans)}
    truth = {i for i, _ in rows if i % 3 == 0}
    assert len(hits & truth) >= 0.9 * len(truth) and len(hits - truth) <= 1


def test_awkward_rows(spark, awkward):
    rows, df = awkward
    assert S.find_secrets(df).count() == len(rows)


def test_empty_table(empty):
    assert S.find_secrets(empty).collect() == []


@pytest.mark.parametrize("value", ["0123456789abcdef", "=" * 20 + "a1", "a1" * 40])
def test_statistics_are_defined(spark, value):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(value,)], "v string").select(S._tested(F.col("v")).alias("t")).head()
    assert 0 <= (row.t.step if row.t.step is not None else 0) <= S.STEPS


def test_no_python_in_the_plan(spark, awkward):
    plan = S.find_secrets(awkward[1])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_each_statistic_of_a_candidate_is_computed_once(spark):
    from pyspark.sql import functions as F

    plan = spark.range(1).select(S._tested(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 8


def test_texts_that_a_scan_leaves_out_hold_no_find(spark):
    """Whatever a base pattern or the method may find, one of the two scans of all texts lets through."""
    r = random.Random(5)
    texts = ["".join(r.choices("ab0f+/_-= :.'\"é\n", k=40)) + r.choice(["", "AKIA" + "A1" * 8, "tOKEN='", "secret : ", "api_key="]) for _ in range(400)]
    texts += [t + v for t in texts[:100] for v in ("abcdef.=/_12", "abcdef.=/_1", "0" * 16, "f" * 15, "=" * 12)]
    for text in texts:
        if brute(text):
            assert re.search(S.LONG, text) or re.search(S.SIGNED, text), text
        assert not any(k == 0 for _, k, _ in brute(text)) or re.search(S.SIGNED, text)
        assert not any(k in (1, 2) for _, k, _ in brute(text)) or re.search(S.LONG, text)
    for row in S.find_secrets(frame(spark, list(enumerate(texts)))).collect():
        assert base(row) == brute(texts[row.doc_id])
