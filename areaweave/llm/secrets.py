"""Secret scans: fixed patterns, and strings too random to be text.

Base patterns find assignments, access keys and long hex runs.  The method adds strings that
a battery of tests takes for random.  Each candidate's encoding is inferred (hex, base 32,
base 36, base 62, base 64); three statistics of its characters follow:

- chi-squared distance from an even use of the encoding's alphabet;
- the number of runs of one character class (letters of either case, digits, the rest);
- the serial correlation of vowels in neighbouring characters.

Each is turned into a p-value under the hypothesis "ordinary text of this length": such text
uses its alphabet unevenly, keeps to one class, and puts vowels beside consonants, the more
plainly the longer it is.  Fisher's method combines the three; within each encoding
and length group the Benjamini-Hochberg rule then holds the share of false finds, over all
candidates of the table, at a given rate.

Only built-in functions; texts are read once and never shuffled.  Two scans of every text tell
which patterns can match in it at all; the others, several times dearer, run where they can.
"""

from __future__ import annotations

import string
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaweave.llm.common import table, written
from areaweave.operators.scale import compute_once

# The base patterns and the least length of what they find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Characters of encodings.  Java looks listed ones up in a table and compares ranges one by one.
_LETTERS = f"[{string.ascii_lowercase}{string.ascii_uppercase}{string.digits}+/_-]"
#: What may be an encoded secret; it must hold a letter as well (digits alone are hex runs).
CANDIDATE = f"(?<!{_LETTERS}){_LETTERS}{{16,}}+={{0,2}}"
#: Found in every text with a candidate, an access key or a hex run, and in every text with an assignment that is kept.
LONG = _LETTERS + "{16}"
SIGNED = rf"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{{ASSIGN_VALUE}}}"""
#: Highest share of false finds among the strings that the tests find.
FALSE_RATE = 0.01
#: Candidates are grouped by length in steps of this many characters, up to LAST_GROUP steps.
GROUP, LAST_GROUP = 8, 16
#: p-values are counted in steps of a tenth of a power of ten, down to 10 ** -STEPS / 10.
STEPS = 300
#: Ordinary text: k times the sum of squared shares of its k letters, less 1; how far it changes
#: classes below chance; correlation of vowels with the character before.
UNEVEN, STICKY, VOWELS = 1.0, 0.5, -0.3
KINDS = ["assign", "access", "hex", "random"]
_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _before(values: str, op) -> Column:
    """For each number of the array column ``values``, ``op`` over all before it, starting from 0.

    Arrays grow by copying, so numbers are taken in blocks of about the square root of their count.
    """
    block = F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")
    zero, none = F.lit(0), F.array().cast("array<int>")

    def grown(numbers, of=lambda x: x):
        first = F.struct(zero.alias("all"), none.alias("before"))
        return F.aggregate(
            numbers,
            first,
            lambda s, x: F.struct(op(s["all"], of(x)).alias("all"), F.concat(s["before"], F.array(s["all"])).alias("before")),
        )

    own = F.transform(F.sequence(zero, block - 1), lambda k: grown(F.slice(values, k * block + 1, block)))
    heads = grown(own, lambda s: s["all"])["before"]
    each = F.zip_with(own, heads, lambda s, head: F.transform(s["before"], lambda x: op(head, x)))
    return F.when(F.size(values) > 0, F.flatten(each)).otherwise(none)


def _with_places(df: DataFrame, name: str, pattern: str, maybe: str) -> DataFrame:
    """Adds ``name``: start and string of all matches, leftmost, not overlapping, in code points.

    Texts of which the column ``maybe`` is false are not looked at.
    """
    value = F.lit(pattern)
    df = compute_once(df, _hit=F.when(F.col(maybe), F.rlike("text", value)).otherwise(F.lit(False)))
    hit = F.col("_hit")
    df = compute_once(
        df,
        _pieces=F.when(hit, F.transform(F.split("text", value, -1), lambda x: F.length(x))).otherwise(F.array().cast("array<int>")),
        _found=F.when(hit, F.regexp_extract_all("text", value, 0)).otherwise(F.array().cast("array<string>")),
    )
    # A match begins after the pieces and the matches before it.
    df = compute_once(df, _steps=F.zip_with("_found", "_pieces", lambda m, p: F.coalesce(F.length(m), F.lit(0)) + p))
    df = compute_once(df, _at=_before("_steps", lambda a, b: a + b))
    each = F.transform("_found", lambda m, i: F.struct((F.get("_at", i) + F.get("_pieces", i)).alias("start"), m.alias("value")))
    return compute_once(df, **{name: each}).drop("_hit", "_pieces", "_found", "_steps", "_at")


def _spans(places: str, kind: str, keep=None) -> Column:
    """Places as (start, kind, stop), those that ``keep`` takes."""
    chosen = F.filter(places, keep) if keep else F.col(places)
    return F.transform(
        chosen,
        lambda p: F.struct(
            p["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            (p["start"] + F.length(p["value"])).alias("stop"),
        ),
    ).cast(_SPANS)


def _below(z: Column) -> Column:
    """Normal distribution function: to three digits, and below -2.5 to four hundredths of its own size."""
    tail = F.exp(-z * z / 2) / (-z * (2 * pi) ** 0.5) * (1 - 1 / (z * z) + 3 / (z * z * z * z) - 15 / (z * z * z * z * z * z))
    return F.when(z < -2.5, tail).otherwise(1 / (1 + F.exp(-z * (1.5976 + 0.070566 * z * z))))


def _let(of, **values: Column) -> Column:
    """``of`` a struct of the values, each computed once however often ``of`` names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(name) for name, v in values.items()])), of), F.lit(0))


def _tested(value: Column) -> Column:
    """Encoding, length group and step of the combined p-value of a candidate string."""
    return _let(lambda s: _let(_of_core, core=s["core"], n=F.length(s["core"]).cast("double")), core=F.rtrim(value, F.lit("=")))


def _of_core(s: Column) -> Column:
    """What the three statistics are made of."""
    core, n = s["core"], s["n"]
    is_hex = core.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    size = (
        F.when(is_hex, 16)
        .when(core.rlike("^[A-Z2-7]+$"), 32)
        .when(core.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36)
        .when(core.rlike("^[0-9A-Za-z]+$"), 62)
        .otherwise(64)
    )
    chars = F.split(core, "")
    counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(core, c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        core, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "o")
    vowel = F.regexp_replace(F.regexp_replace(core, "[aeiouAEIOU]", "~"), "[^~]", ".")
    return _let(_of_strings, n=n, size=size, squares=squares, classes=classes, vowel=vowel)


def _of_strings(s: Column) -> Column:
    n, classes, vowel = s["n"], s["classes"], s["vowel"]
    shares = [(n - F.length(F.replace(classes, F.lit(c), F.lit("")))) / n for c in "ludo"]
    return _let(
        _of_counts,
        n=n,
        size=s["size"],
        squares=s["squares"],
        **{c: share for c, share in zip("ludo", shares, strict=True)},
        changes=F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1,
        share=(n - F.length(F.replace(vowel, F.lit("~"), F.lit("")))) / n,
        pairs=F.length(F.regexp_replace(vowel, "~(?!~)|[.]", "")).cast("double"),  # vowels before a vowel
    )


def _of_counts(s: Column) -> Column:
    n, size, changes, share, pairs = (s[c] for c in ("n", "size", "changes", "share", "pairs"))
    chi = size / n * s["squares"] - n
    even = (chi - (size - 1 + n * UNEVEN)) / F.sqrt(2 * (size - 1) + 4 * n * UNEVEN)

    chance = (1 - STICKY) * (1 - sum(s[c] * s[c] for c in "ludo"))
    runs = ((n - 1) * chance - changes) / F.sqrt(F.greatest((n - 1) * chance * (1 - chance), F.lit(0.1)))

    spread = F.greatest(share * (1 - share), F.lit(0.01))
    serial = F.greatest(F.lit(-0.9), F.least(F.lit(0.9), (pairs / (n - 1) - share * share) / spread))
    z_serial = (F.atanh(F.lit(VOWELS)) - F.atanh(serial)) * F.sqrt(n - 3)
    # One class and only vowels, or none (xxxx...): nothing that could correlate.
    alike = (changes == 0) & ((share == 0) | (share == 1))
    return _let(_of_scores, n=n, size=size, even=even, runs=runs, serial=z_serial, alike=alike)


def _of_scores(s: Column) -> Column:
    n, size = s["n"], s["size"]
    ps = _below(s["even"]), _below(s["runs"]), F.when(s["alike"], 1.0).otherwise(_below(s["serial"]))

    def result(t):
        x = t["x"]
        combined = F.exp(-x) * (1 + x + x * x / 2)
        step = F.least(F.lit(STEPS), F.floor(-10 * F.log10(combined) + 1e-9)).cast("int")
        group = F.least(F.lit(LAST_GROUP), F.floor(n / GROUP)).cast("int")
        return F.struct((size * 100 + group).cast("int").alias("group"), step.alias("step"))

    return _let(result, x=-sum(F.ln(F.greatest(p, F.lit(1e-12))) for p in ps))


def _thresholds(found: DataFrame, rate: float) -> Column:
    """The step from which each group's candidates are finds, as a map of at most 85 entries."""
    counted = found.select(F.inline(F.col("candidates.test"))).groupBy("group", "step").agg(F.count("*").alias("n"))
    group = Window.partitionBy("group")
    least = F.pow(F.lit(10.0), -F.col("step") / 10)
    cut = (
        counted.withColumn("above", F.sum("n").over(group.orderBy(F.desc("step"))))
        .withColumn("all", F.sum("n").over(group))
        .filter(F.col("all") * least <= rate * F.col("above"))
        .groupBy("group")
        .agg(F.min("step").alias("step"))
    )
    known = [F.lit(x) for row in cut.collect() for x in (row["group"], row["step"])]
    return F.create_map(*known) if known else F.lit(None).cast("map<int,int>")


def find_secrets(docs: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """The secrets of each text: doc_id and ``spans`` of (start, kind, stop), in order.

    Kinds are numbered as in KINDS; places are code points, the end exclusive.  Strings that
    a base pattern has found already are not found again.  ``text`` null counts as empty;
    other columns do not count; repeated rows are scanned each, and all count as candidates.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = compute_once(df, _signed=F.rlike("text", F.lit(SIGNED)), _long=F.rlike("text", F.lit(LONG)))
    df = _with_places(df, "_assign", ASSIGN, "_signed")
    for name, pattern in (("_access", ACCESS), ("_hex", HEX), ("_maybe", CANDIDATE)):
        df = _with_places(df, name, pattern, "_long")
    # Of an assignment the value counts: what is left without the word, the sign and the quote.
    long_value = lambda p: F.length(F.regexp_extract(p["value"], ASSIGN, 2)) >= ASSIGN_VALUE
    base = F.concat(_spans("_assign", "assign", long_value), _spans("_access", "access"), _spans("_hex", "hex"))
    df = compute_once(df.drop("text"), base=F.array_sort(base))
    letters = lambda p: p["value"].rlike("[A-Za-z]") & (F.length(F.rtrim(p["value"], F.lit("="))) >= 16)
    df = compute_once(df, _maybe=F.filter("_maybe", letters))
    # Candidates and base spans in one order; candidates (kind -1) never overlap each other.
    mixed = F.transform(
        "_maybe",
        lambda p: F.struct(p["start"].alias("start"), F.lit(-1).alias("kind"), (p["start"] + F.length(p["value"])).alias("stop"), p["value"].alias("value")),
    )
    based = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop"), F.lit("").alias("value")))
    df = compute_once(df, _mixed=F.array_sort(F.concat(based, mixed)))
    df = compute_once(df, _stops=F.transform("_mixed", lambda s: F.when(s["kind"] >= 0, s["stop"]).otherwise(F.lit(0))))
    df = compute_once(df, _reach=_before("_stops", F.greatest))

    def outside(s, i):
        """Not a base span, none before reaches into it, and the next one begins after it (one at its own start follows it)."""
        after = F.get("_mixed", i + 1)
        return (s["kind"] < 0) & (F.get("_reach", i) <= s["start"]) & F.coalesce(after["start"] >= s["stop"], F.lit(True))

    maybe = F.transform(
        F.filter("_mixed", outside),
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), _tested(s["value"]).alias("test")),
    )
    found = written(df.select("doc_id", "base", maybe.alias("candidates")))
    cut = _thresholds(found, rate)
    chosen = F.filter("candidates", lambda c: c["test"]["step"] >= F.element_at(cut, c["test"]["group"]))
    random = F.transform(
        chosen,
        lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["stop"].alias("stop")),
    ).cast(_SPANS)
    return found.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:stop, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ","
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base finds of every document, and all spans."""
    done = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))
    return done.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(of("random")).cast("long").alias("n_random"),
    )
