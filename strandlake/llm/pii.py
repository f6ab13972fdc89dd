"""Personal data by candidate generation and gradient-boosted trees, in DataFrame functions only.

High-recall generators propose spans, which may overlap: the four base kinds by their patterns, and
runs of digits and of mixed letters and digits. Base spans that pass their kind's check are certain.
They also teach: boosted trees learn from all candidates (valid base spans and values
assigned to a credential word against the rest) which format and context make a candidate personal,
and a threshold for each kind, calibrated on their other half, selects further spans from the
generic generators where no certain span lies.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.tables import local_table
from strandlake.llm.common import masked, small_or_shuffled, stored

KINDS = ["email", "ip", "card", "phone"]
#: Share of selected candidates that must be positive in the calibration half.
PRECISION = 0.95
BEFORE, AFTER = 24, 12
#: Characters of the pieces that a text to be redacted is cut from. Never changes a result.
PIECE = 4096

# A run that a match begins is entered at its start or where the match before ended, which finds the
# same leftmost matches as a plain search without trying every letter of every word: linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![A-Za-z0-9])[(]?[0-9][0-9\x20().-]{4,22}[0-9](?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{10,}+",
}
#: What a text must match for its kind's pattern to be tried; texts without a digit only try email.
_NEEDS = {"email": "@", "phone": "+"}
_CREDENTIAL = r"(?i)(?:token|password|passwd|secret|api.?key|key)[\x20]*[=:][\x20]*[\"']?$"
_EVIDENCE = r"(?i)(?<![A-Za-z])(?:tel|phone|call|mobile|fax|card|account|ssn|iban)[.:#]?[\x20]*$"
_CONTACT = r"(?i)(?:tel|phone|call|mobile|fax|card|account|id|ssn|iban|mail)[.:#]?[\x20]*$"

FEATURES = [
    "n_chars", "n_digits", "n_letters", "n_upper", "n_separators", "n_groups", "distinct", "has_at", "has_plus", "n_dots", "luhn",
    "octets", "spaced", "credential", "contact", "quoted", "assigned",
]
#: What the trees see: nothing that a base kind's check or an evidence word decides.
FORMAT = ["n_chars", "n_digits", "n_letters", "n_upper", "n_separators", "n_groups", "distinct", "n_dots", "spaced"]


def _prior() -> list[tuple[str, str, float]]:
    """(kind, value, label) of common formats, so that tables without evidence have a model too."""
    out = []
    for k in range(40):
        a, b, c = 201 + 17 * k % 790, 200 + 71 * k % 800, 1000 + 367 * k % 9000
        letters = "".join("abcdef0123456789"[(k * 7 + i * i * 5 + 3 * i) % 16] for i in range(20)) + "a1"
        out += [("number", v, 1.0) for v in (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{10 + k}-{c}", f"{4000 + k} {c} {9999 - c} {1000 + b}")]
        out += [("number", v, 0.0) for v in (f"{1900 + 3 * k}-{1 + k % 12:02d}-{1 + k % 28:02d}", f"{a}.{b}.0", f"{1 + k % 28:02d}.{1 + k % 12:02d}.{1900 + 3 * k}", f"{a}.{k % 100:02d}0", f"{1900 + k}-{1950 + k}")]
        out += [("secret", letters, 1.0), ("secret", f"item{1000000 + 36713 * k}abc", 0.0), ("secret", f"chapter-{k}-notes", 0.0)]
    return out


def _luhn(digits: Column) -> Column:
    """Whether a string of 1 to 19 digits passes the Luhn sum."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).try_cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.coalesce(F.when(i % 2 == 0, twice).otherwise(d), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _octets_fit(value: Column) -> Column:
    """Whether all dot-separated numbers are at most 255."""

    def fits(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), fits)


def candidates(texts: DataFrame) -> DataFrame:
    """(row, kind, number, start, end, value, before, after) of every generator's matches in texts
    (row, text), starts and ends in code points; null texts have none. row must be unique."""
    with_digit = F.col("text").rlike("[0-9]")
    needed = {k: F.contains("text", F.lit(_NEEDS[k])) if k in _NEEDS else with_digit for k in PATTERNS}
    matches = texts.select(
        "row", *[F.when(needed[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"{k}_m") for k, p in PATTERNS.items()],
        *[F.when(needed[k], F.split("text", p)).alias(f"{k}_p") for k, p in PATTERNS.items()],
    )

    def rows(kind: str) -> Column:
        found, pieces = F.col(f"{kind}_m"), F.col(f"{kind}_p")
        one = lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("number"), F.length(F.get(pieces, i)).alias("gap"), m.alias("value"),
            F.substr(F.get(pieces, i), -F.least(F.lit(BEFORE), F.length(F.get(pieces, i)))).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after"),
        )
        return F.coalesce(F.transform(found, one), F.array())

    every = matches.select("row", F.explode(F.concat(*[rows(k) for k in PATTERNS])).alias("c")).select("row", "c.*")
    so_far = Window.partitionBy("row", "kind").orderBy("number")
    end = F.sum(F.col("gap") + F.length("value")).over(so_far)
    placed = every.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("value")).cast("int"))
    return placed.select("row", "kind", "number", "start", "end", "value", "before", "after")


def with_features(found: DataFrame) -> DataFrame:
    """candidates plus valid (the base kind's check holds; false for generic kinds) and FEATURES."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    luhn = F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    octets = F.when(value.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), _octets_fit(value)).otherwise(False)
    valid = (
        F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "card", n.between(16, 19) & luhn).when(F.col("kind") == "phone", n.between(8, 15)).otherwise(False)
    )
    made = {
        "n_chars": F.length(value).cast("double"), "n_digits": n.cast("double"), "n_letters": count("[A-Za-z]"), "n_upper": count("[A-Z]"), "n_separators": count(r"[\x20().-]"),
        "n_groups": count("[0-9]+"), "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double"), "has_at": F.contains(value, F.lit("@")).cast("double"),
        "has_plus": (value.startswith("+") | before.endswith("+")).cast("double"), "n_dots": count(r"\."), "luhn": luhn.cast("double"), "octets": octets.cast("double"),
        "spaced": (before.rlike(r"(^|[\x20\n])$") & after.rlike(r"^([\x20\n.,;]|$)")).cast("double"), "credential": before.rlike(_CREDENTIAL).cast("double"),
        "contact": before.rlike(_CONTACT).cast("double"), "quoted": before.rlike("[\"']$").cast("double"), "assigned": before.rlike(r"[=:][\x20]*[\"']?$").cast("double"),
    }
    return found.withColumn("valid", valid).withColumns({k: F.coalesce(made[k], F.lit(0.0)) for k in FEATURES})


def with_evidence(featured: DataFrame) -> DataFrame:
    """featured plus evidence: a generic candidate's word before it tells that it is personal; and label:
    that, or a number overlaps a valid span of a kind made of digits."""
    told = F.col("kind").isin("number", "secret") & ((F.col("credential") == 1) | F.col("before").rlike(_EVIDENCE))
    digits = F.col("valid") & (F.col("kind") != "email")
    order = Window.partitionBy("row").orderBy("start")
    reach = F.max(F.when(digits, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    # read backwards, since only frames that begin with a partition are summed up row by row
    following = F.min(F.when(digits, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    over = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    return featured.withColumn("evidence", told).withColumn("label", (told | ((F.col("kind") == "number") & over)).cast("double"))


def fit(found: DataFrame):
    """(model, thresholds by kind) from all candidates with_evidence; a kind of which no threshold is precise enough has none.

    Candidates that look alike to the trees are one row, weighted by their number."""
    generic = found.where(F.col("kind").isin("number", "secret")).withColumn("key", F.xxhash64("value", "before", "after"))
    different = generic.groupBy("kind", "key").agg(F.max("label").alias("label"), *[F.first(c).alias(c) for c in FORMAT])
    prior = local_table(found.sparkSession, _prior(), "kind string, value string, label double").withColumns({"before": F.lit(" "), "after": F.lit(" ")})
    columns = ["kind", "label", (F.pmod("key", F.lit(2)) == 0).alias("fit"), *FORMAT]
    every = different.select(*columns).union(with_features(prior).withColumn("key", F.xxhash64("value")).select(*columns))
    alike = stored(every.groupBy("kind", "label", "fit", *FORMAT).agg(F.count("*").cast("double").alias("weight")))
    assembled = VectorAssembler(inputCols=FORMAT, outputCol="features").transform(alike)
    # of more rows than the square of its bins and 10 000 Spark would look for splits in a sample alone
    rows = alike.where("fit").count()
    bins = 32 if rows <= 10_000 else isqrt(rows) + 1
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=8, maxDepth=3, stepSize=0.3, seed=11, maxBins=bins, checkpointInterval=-1)
    model = trees.fit(assembled.where("fit"))
    scored = model.transform(assembled.where(~F.col("fit"))).select("kind", "label", "weight", F.round(vector_to_array("probability")[1], 4).alias("p"))
    by_score = scored.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("weight")).alias("hits"), F.sum("weight").alias("n")).orderBy("kind", F.desc("p")).collect()  # 10 001 scores a kind at most
    thresholds: dict[str, float] = {}
    for kind, rows in groupby(by_score, key=lambda r: r.kind):
        hits, n = 0.0, 1.0  # one miss is assumed
        for r in rows:
            hits, n = hits + r.hits, n + r.n
            if hits >= PRECISION * n:
                thresholds[kind] = r.p
    return model, thresholds


def detect(texts: DataFrame) -> DataFrame:
    """(row, kind, start, end, base) of the spans in texts (row, text): all base spans, and of the
    generic kinds those that the trees or evidence words select where no base span and no earlier selected span lies."""
    featured = stored(with_evidence(with_features(candidates(texts))))
    base = featured.where("valid").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    model, thresholds = fit(featured)
    generic = model.transform(VectorAssembler(inputCols=FORMAT, outputCol="features").transform(featured.where(F.col("kind").isin("number", "secret"))))
    least = F.lit(None).cast("double")
    for kind, p in thresholds.items():
        least = F.when(F.col("kind") == kind, p).otherwise(least)
    selected = F.col("evidence") | F.coalesce(F.round(vector_to_array("probability")[1], 4) >= least, F.lit(False))
    chosen = generic.where(selected).select("row", "kind", "start", "end", F.lit(False).alias("base"))
    both = base.union(chosen)
    order = Window.partitionBy("row").orderBy("start", F.desc("base"), F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    backwards = Window.partitionBy("row").orderBy(F.desc("start"), "base", "end", F.desc("kind"))
    next_base = F.min(F.when(F.col("base"), F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (next_base.isNull() | (next_base >= F.col("end")))
    return both.withColumn("free", free).where("base or free").drop("free")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base_spans, spans) for every row of docs (doc_id, text): arrays of (kind, start, end),
    by kind (the base kinds as in KINDS, then others by name) and start.

    Null text counts as empty; repeated rows are searched each; an empty table gives an empty one;
    other columns are ignored; long texts are searched whole. Texts are stored once with a row number, since they are read twice.
    """
    kept = stored(docs.select("doc_id", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row")))
    return kept.select("row", "doc_id").join(_by_row(detect(kept.select("row", "text"))), "row", "left").select("doc_id", *[F.coalesce(c, F.array().cast("array<struct<place:int,kind:string,start:int,end:int>>")).alias(c) for c in ("base_spans", "spans")])


def _by_row(spans: DataFrame) -> DataFrame:
    place = reduce(lambda rest, k: F.when(F.col("kind") == KINDS[k], k).otherwise(rest), range(len(KINDS)), F.lit(len(KINDS)))
    one = F.struct(place.alias("place"), "kind", "start", "end")
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), one))).alias("base_spans"), F.sort_array(F.collect_list(one)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns whatever their names, with every span of personal data in text replaced by its kind in
    brackets.

    Spans that overlap are replaced together, under the first one's kind. Null texts stay null; long texts are
    searched whole; rows repeated are redacted each.
    """
    own, place, back = masked(docs)
    text = place["text"]
    kept = stored(own.withColumn("row", F.monotonically_increasing_id()))
    spans = detect(kept.select("row", F.col(text).alias("text")))
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    chained = starts.withColumn("chain", F.sum("new").over(order))
    merged = chained.groupBy("row", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    lists = merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    joined = kept.join(small_or_shuffled(lists), "row", "left")
    # parts are cut from pieces of PIECE characters, so that no part is looked for from a long text's beginning on
    joined = joined.withColumn("pieces", F.when(F.col("spans").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    at = lambda place: F.floor(place / PIECE).cast("int")
    cut = lambda lo, hi: F.when(hi > lo, F.substr(F.array_join(F.slice("pieces", at(lo) + 1, at(hi - 1) - at(lo) + 1), ""), lo % PIECE + 1, hi - lo)).otherwise("")
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"])
    part = lambda s, i: F.concat(cut(before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    tail = cut(F.element_at("spans", -1)["end"], F.length(text))
    changed = F.concat(F.array_join(F.transform("spans", part), ""), tail)
    return back(joined.withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(changed)))
