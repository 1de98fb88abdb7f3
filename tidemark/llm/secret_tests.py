"""Secret scan by a randomness test battery, in DataFrame operations only.

Base spans come from three patterns (assignments, access keys, hex runs).  The
battery adds strings that look random.  Candidates are maximal runs of encoding
characters; each gets an encoding by its characters (hex, base32, alphanumeric,
base64, base64url), with the number of symbols ``k`` that goes with it.  A run that mixes
'/' or '+' with '-' or '_' (a path, a URL) fits none; in its place its parts of 20
characters or more are candidates, cut at one of the two sorts or at both, and of parts that
overlap the longest that passes is kept.

Tests of randomness, per candidate of ``n`` symbols with values 0..k-1:

* chi-squared of the symbol counts against the uniform alphabet,
* runs of values below and above the middle (Wald-Wolfowitz),
* serial correlation of neighbouring values.

The three p-values are joined by Fisher's method; strings that are not random
(sequences, repeats, words) fall here.  Short strings have little power against
ordinary text, so a second p-value comes from the likelihood ratio of text to random
symbols, which under text is at most ``p`` with probability ``p`` at most.  Text
keeps to its class of symbols (small letters, capitals, digits, signs) as ``TURNS``
says and has the letter frequencies of English, a tenth of it even.  On
these p-values the false discovery rate is held by the Benjamini-Hochberg rule,
within each class of encoding and length octave, so that many short candidates
cannot lend significance to each other or borrow it from long ones.  The rule
needs only counts per step of a fixed logarithmic grid of p-values, never a global
sort; a candidate is judged by the upper edge of its step, which is on the safe side.

Spans are ``kind:start:end`` in code points.  Added spans have the kind of their
encoding with ``random_`` before it and are left out where a base span has the
same place.

Defined cases: null and empty texts have no spans; repeated rows and repeated
doc_ids each keep their own row; an empty table gives an empty result; texts of
any length are read whole, at a cost in proportion to their spans: places are running sums over a text's
matches, and covered candidates come from one pass over its spans in order; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# Fixed values of the base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Parts of a run that mixes the signs of base64 and base64url: cut at either's, or at both's.
PARTS = ("[A-Za-z0-9+/]{20,}={0,2}", "[A-Za-z0-9_-]{20,}={0,2}", "[A-Za-z0-9]{20,}={0,2}")
KINDS = ("assign", "access", "hex")

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name, pattern of the whole string, alphabet in value order.
ENCODINGS = (
    ("hex", "[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    ("base32", "[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "[A-Za-z0-9]+", UPPER + LOWER + DIGITS),
    ("base64", "[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "-_"),
)
#: Text: weights of the letters from A to Z, and for each class of symbols (small letters, capitals, digits, signs) how often
#: text begins with it and goes on to each of the classes.
ENGLISH = (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 0.95, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.74)
MIXED = ((0.6, 0.25, 0.1, 0.05), ((0.9, 0.05, 0.02, 0.03), (0.4, 0.55, 0.02, 0.03), (0.08, 0.04, 0.8, 0.08), (0.6, 0.2, 0.15, 0.05)))
TURNS = {
    "hex": ((0.5, 0, 0.5, 0), ((0.85, 0, 0.15, 0), (0, 0, 0, 0), (0.05, 0, 0.95, 0), (0, 0, 0, 0))),
    "base32": ((0, 0.5, 0.5, 0), ((0, 0, 0, 0), (0, 0.98, 0.02, 0), (0, 0.15, 0.85, 0), (0, 0, 0, 0))),
    "alnum": MIXED,
    "base64": MIXED,
    "base64url": MIXED,
}
EVEN = 0.1  # share of text whose letters are evenly spread: names, foreign words, codes
GRID = 20  # steps of the p-value grid per power of e
GRID_END = 2000


PIECE = "array<struct<kind:string,gap:int,long:int,match:string>>"


def _pieces(text, pattern: str, kind: str):
    """Leftmost non-overlapping matches in order, each with its length and the gap before it; texts without one are not split."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.zip_with(
        F.split(text, pattern, -1), matches, lambda p, m: F.struct(F.lit(kind).alias("kind"), F.char_length(p).alias("gap"), F.char_length(m).alias("long"), m.alias("match"))
    )
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(found, lambda f: f["match"].isNotNull())).otherwise(F.array().cast(PIECE))


def _spans(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each match of the arrays ``pieces``: ``keys``, ``kind, start, end, match`` in code points, by running sums over a text's matches."""
    rows = pieces.select(*keys, F.posexplode("pieces").alias("at", "p")).select(*keys, "at", "p.*")
    along = Window.partitionBy(*keys, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(along).cast("int"))
    return ends.select(*keys, "kind", (F.col("end") - F.col("long")).alias("start"), "end", "match")


def scan(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, candidates``: one row per document with the matches in order, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.concat(_pieces(text, ASSIGN, "assign"), _pieces(text, ACCESS, "access"), _pieces(text, HEX, "hex")).alias("base"),
            _pieces(text, CANDIDATE, "random").alias("candidates"),
        ),
        "secret-scan",
    )


def base_spans(scanned: DataFrame) -> DataFrame:
    """``row, kind, start, end, match`` of the base patterns."""
    found = _spans(scanned.filter(F.size("base") > 0).select("row", F.col("base").alias("pieces")), ["row"])
    value = F.regexp_extract("match", ASSIGN, 1)
    return found.filter((F.col("kind") != "assign") | (F.char_length(value) >= ASSIGN_LEAST))


def candidate_spans(scanned: DataFrame) -> DataFrame:
    """Candidates ``row, run, start, end, match``, ``run`` being the start of the run: runs of mixed signs in their parts."""
    runs = _spans(scanned.filter(F.size("candidates") > 0).select("row", F.col("candidates").alias("pieces")), ["row"]).withColumnRenamed("start", "run")
    mixed = F.rlike("match", F.lit("[+/]")) & F.rlike("match", F.lit("[_-]"))
    within = F.concat(*(_pieces(F.col("match"), pattern, f"{k}") for k, pattern in enumerate(PARTS)))
    parts = _spans(runs.filter(mixed).select("row", "run", within.alias("pieces")), ["row", "run"])
    parts = parts.select("row", "run", (F.col("run") + F.col("start")).alias("start"), (F.col("run") + F.col("end")).alias("end"), "match").distinct()
    return runs.filter(~mixed).select("row", "run", F.col("run").alias("start"), "end", "match").unionAll(parts)


def covered(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """The candidates with ``covered``: whether a base span of their text has their place, seen from the furthest end of those that begin before."""
    spans = base.select("row", F.lit(None).cast("int").alias("run"), "start", "end", F.lit(None).cast("string").alias("match"))
    before = Window.partitionBy("row").orderBy("start", F.col("run").isNotNull()).rangeBetween(Window.unboundedPreceding, 0)
    furthest = F.max(F.when(F.col("run").isNull(), F.col("end"))).over(before)
    both = candidates.unionByName(spans).withColumn("covered", F.coalesce(furthest >= F.col("end"), F.lit(False)))
    return both.filter("run IS NOT NULL")


def _longest(spans):
    """Of spans that overlap the longest (then the first): spans are taken by falling length where they are free."""
    sized = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("less"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match")))
    taken = F.aggregate(
        F.array_sort(sized),
        F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>"),
        lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(
            F.concat(kept, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))))
        ),
    )
    return F.when(F.size(spans) > 1, taken).otherwise(spans)


def without_overlaps(chosen: DataFrame) -> DataFrame:
    """``row, kind, start, end, match``: of overlapping parts of a run the longest; only spans that hang together are compared."""
    ahead = Window.partitionBy("row", "run").orderBy("start", "end")
    apart = F.col("start") >= F.coalesce(F.max("end").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    knots = chosen.withColumn("apart", apart.cast("int")).withColumn("knot", F.sum("apart").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct(F.concat(F.lit("random_"), "encoding").alias("kind"), "start", "end", "match")
    tied = knots.groupBy("row", "run", "knot").agg(F.collect_list(span).alias("spans"))
    return tied.select("row", F.explode(_longest(F.col("spans"))).alias("s")).select("row", "s.*")


def _normal_sf(z):
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17 via exp; relative error small in the bulk)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _class_of(symbol: str) -> int:
    return 0 if symbol.islower() else 1 if symbol.isupper() else 2 if symbol.isdigit() else 3


def _text_ratio(name: str, letters: str):
    """Log likelihood of ``codes`` as text less that as random symbols of an encoding."""
    start, turns = TURNS[name]
    kinds = [_class_of(c) for c in letters]
    weight = [ENGLISH[UPPER.index(c.upper())] if c.isalpha() else 1.0 for c in letters]
    share = []
    for kind, w in zip(kinds, weight, strict=True):
        own = [x for k, x in zip(kinds, weight, strict=True) if k == kind]
        share.append((1 - EVEN) * w / sum(own) + EVEN / len(own))
    symbols = F.array(*(F.lit(math.log(q * len(letters))) for q in share))
    classes = F.array(*map(F.lit, kinds))
    begin = F.array(*(F.lit(math.log(max(x, 1e-9))) for x in start))
    onward = F.array(*(F.lit(math.log(max(x, 1e-9))) for row in turns for x in row))

    def step(s, c):
        kind = F.get(classes, c.cast("int"))
        turn = F.when(s["kind"] < 0, F.get(begin, kind)).otherwise(F.get(onward, s["kind"] * 4 + kind))
        return F.struct((s["sum"] + F.get(symbols, c.cast("int")) + turn).alias("sum"), kind.alias("kind"))

    return F.aggregate("codes", F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("kind")), step, lambda s: s["sum"])


def test_strings(strings: DataFrame, column: str = "match") -> DataFrame:
    """Adds ``encoding, n, chi2, p_uniform, p_runs, p_serial, p_random, log_text`` to candidates of known encodings."""
    body = F.regexp_replace(F.col(column), "=+$", "")
    name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for title, pattern, letters in reversed(ENCODINGS):
        fits = F.rlike(body, F.lit(f"^(?:{pattern})$"))
        name, alphabet = F.when(fits, title).otherwise(name), F.when(fits, letters).otherwise(alphabet)
    rows = strings.withColumns({"encoding": name, "alphabet": alphabet}).filter("encoding IS NOT NULL")
    rows = rows.withColumn("body", F.when(F.col("encoding") == "hex", F.lower(body)).otherwise(body))
    rows = rows.withColumns({"n": F.char_length("body").cast("double"), "k": F.char_length("alphabet").cast("double")})
    counts = F.transform(F.split("alphabet", ""), lambda a: (F.col("n") - F.char_length(F.replace(F.col("body"), a, F.lit("")))).cast("double"))
    codes = F.expr("transform(split(body, ''), c -> cast(locate(c, alphabet) - 1 as double))")
    rows = rows.withColumns({"counts": counts, "codes": codes})
    total = lambda a, f: F.aggregate(a, F.lit(0.0), f)
    squares = total(F.col("counts"), lambda s, c: s + c * c)
    high = total(F.col("codes"), lambda s, c: s + F.when(c >= F.col("k") / 2, 1.0).otherwise(0.0))
    pairs = F.zip_with(F.slice("codes", 1, F.size("codes") - 1), F.slice("codes", 2, F.size("codes") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    turns = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when((p["a"] >= F.col("k") / 2) != (p["b"] >= F.col("k") / 2), 1.0).otherwise(0.0))
    centre = (F.col("k") - 1) / 2
    lagged = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - centre) * (p["b"] - centre))
    spread = total(F.col("codes"), lambda s, c: s + (c - centre) * (c - centre))
    rows = rows.withColumns({"chi2": F.col("k") / F.col("n") * squares - F.col("n"), "high": high, "turns": turns, "serial": F.coalesce(F.try_divide(lagged, spread), F.lit(1.0))})
    n, k = F.col("n"), F.col("k")
    # chi-squared, mean and variance exact for the uniform alphabet at any n
    z_uniform = (F.col("chi2") - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    low = n - F.col("high")
    mean_runs = 2 * F.col("high") * low / n + 1
    var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9))
    z_runs = F.when((F.col("high") == 0) | (low == 0), F.lit(40.0)).otherwise(F.abs(F.col("turns") + 1 - mean_runs) / F.sqrt(var_runs))
    z_serial = F.abs(F.col("serial")) * F.sqrt(n)
    floor = F.lit(1e-300)
    rows = rows.withColumns(
        {
            "p_uniform": F.greatest(_normal_sf(z_uniform), floor),
            "p_runs": F.greatest(F.least(2 * _normal_sf(z_runs), F.lit(1.0)), floor),
            "p_serial": F.greatest(F.least(2 * _normal_sf(z_serial), F.lit(1.0)), floor),
        }
    )
    half = -(F.ln("p_uniform") + F.ln("p_runs") + F.ln("p_serial"))  # half of Fisher's statistic, 6 degrees of freedom
    rows = rows.withColumn("half", half).withColumn("p_random", F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2))
    log_text = F.lit(None).cast("double")
    for title, _, letters in ENCODINGS:
        log_text = F.when(F.col("encoding") == title, F.least(_text_ratio(title, letters), F.lit(0.0))).otherwise(log_text)
    return rows.withColumn("log_text", log_text).drop("counts", "codes", "high", "turns", "half", "alphabet")


def discoveries(tested: DataFrame, rate: float = 0.01, least_random: float = 1e-4) -> DataFrame:
    """The candidates that pass the battery and the length-aware false discovery control."""
    octave = F.floor(F.log2("n")).cast("int")
    step = F.least(F.floor(-F.col("log_text") * GRID), F.lit(GRID_END * GRID)).cast("int")
    graded = tested.withColumns({"octave": octave, "step": step})
    steps = graded.groupBy("encoding", "octave", "step").agg(F.count(F.lit(1)).alias("c"))
    # a class has one row per step of a fixed grid at most
    steepest = Window.partitionBy("encoding", "octave").orderBy(F.desc("step"))
    sums = steps.withColumns({"beyond": F.sum("c").over(steepest), "all": F.sum("c").over(Window.partitionBy("encoding", "octave"))})
    passed = sums.filter(F.exp(-F.col("step") / F.lit(float(GRID))) * F.col("all") <= rate * F.col("beyond"))
    limits = passed.groupBy("encoding", "octave").agg(F.min("step").alias("limit"))
    return graded.join(limits, ["encoding", "octave"]).filter((F.col("step") >= F.col("limit")) & (F.col("p_random") >= least_random))


def _joined(spans):
    """``kind:start:end`` by start, then kind in the listed order."""
    order = F.create_map(*(v for k, name in enumerate((*KINDS, *(f"random_{e[0]}" for e in ENCODINGS))) for v in (F.lit(name), F.lit(k))))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """``row, doc_id, base, added``: arrays of spans per document."""
    scanned = scan(docs)
    base = staged(base_spans(scanned), "secret-base")
    tested = staged(test_strings(covered(candidate_spans(scanned), base)), "secret-tests")
    added = without_overlaps(discoveries(tested, rate).filter(~F.col("covered")))
    spans = base.select("*", F.lit(True).alias("own")).unionAll(added.select("*", F.lit(False).alias("own")))
    span = F.struct("kind", "start", "end", "match")
    arrays = spans.groupBy("row").agg(F.collect_list(F.when(F.col("own"), span)).alias("base"), F.collect_list(F.when(~F.col("own"), span)).alias("added"))
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    whole = scanned.select("row", "doc_id").join(arrays, "row", "left")
    return whole.select("row", "doc_id", F.coalesce("base", nothing).alias("base"), F.coalesce("added", nothing).alias("added"))


def secret_query(docs: DataFrame) -> DataFrame:
    spans = secret_spans(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )
