"""Chat formatting: transcripts are parsed by a hidden Markov model, their turns rendered canonically.

A transcript is lines of text; some turns begin with a speaker marker, others with nothing that tells. Hidden states are
a role and whether the line begins a turn of it; lines are emissions. A line's features are the role that a
marker at its start names (if any), its length, its place in the transcript and its punctuation. Counts of
first states, state pairs and features by state are taken over all lines of conversations that carry roles;
Viterbi decoding then gives every line the state of the transcript's most probable sequence, and lines from one
beginning to the next are a turn.

Viterbi is a product of matrices over (max, +), so a transcript of any length is decoded in
chunks: every chunk is reduced to one small matrix in parallel, the chunks of a transcript are
chained (one row for a chunk), and every chunk is decoded in parallel between its two end states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import ascii_lower, remainder, stored

CHUNK = 512
#: Chunks that are chained at a time; a level of matrices is added for every factor of this many.
FAN = 512
#: Different roles of one model; more are an error, none is left out.
MAX_ROLES = 24

# Markers at a line's start and the role that each names, and a turn's rendering.
MARKERS = {
    "user": ["user", "human", "question", "q", "customer", "prompt"],
    "assistant": ["assistant", "ai", "bot", "answer", "a", "agent", "gpt", "model"],
    "system": ["system", "sys", "instructions"],
    "tool": ["tool", "function", "observation"],
}
_OPEN, _CLOSE = "<|start|>", "<|end|>"
_MARKER = r"^\s*(?:[*#>\[<|]*\s*)([A-Za-z]+)(?:\s*[*\]>|]*)\s*[:>|\]]\s*"

_ARROW = {"long": pa.int64(), "array<double>": pa.list_(pa.float64()), "string": pa.string()}

FEATURES = ["marker", "size", "place", "form"]
_BEGINS, _GOES_ON = ">", "."


def marker_role(text: Column) -> Column:
    """The role that a speaker marker at the text's start names, or none."""
    name = ascii_lower(F.regexp_extract(text, _MARKER, 1))
    out = F.lit("none")
    for role, names in MARKERS.items():
        out = F.when(name.isin(names), role).otherwise(out)
    return F.when(text.isNull(), "none").otherwise(out)


def without_marker(text: Column) -> Column:
    """The text without a speaker marker that names a role."""
    return F.when(marker_role(text) != "none", F.regexp_replace(text, _MARKER, "")).otherwise(text)


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, line, text, state) of conversations (conv_id, turn, role, text): their transcripts, a row a
    line, and the state that each is in (null without a role).

    Three of four transcripts have speaker markers, of three kinds, in front of turns of the roles in MARKERS;
    the rest have none. Turns of one number go by a hash of role and text (tie)."""
    names = [F.create_map(*[x for role, own in MARKERS.items() for x in (F.lit(role), F.lit(f"{left}{own[k]}{right}"))]) for k, (left, right) in enumerate([("", ": "), ("### ", ": "), ("**", "**: ")])]
    marker = F.get(F.array(*[n[F.col("role")] for n in names]), F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int"))
    lines = conversations.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("tie"), marker.alias("marker"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "own"))
    first = F.col("line") == 0
    text = F.when(first, F.concat(F.coalesce("marker", F.lit("")), "own")).otherwise(F.col("own"))
    return lines.select("conv_id", "turn", "tie", "line", text.alias("text"), F.concat("role", F.when(first, _BEGINS).otherwise(_GOES_ON)).alias("state"))


def text_lines(transcripts: DataFrame) -> DataFrame:
    """The same rows, without states, of transcripts (conv_id, text) that are whole texts; rows of one conv_id go by a
    hash of the text."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text")
    return transcripts.select("conv_id", F.lit(0).alias("turn"), F.xxhash64("text").alias("tie"), lines).withColumn("state", F.lit(None).cast("string"))


def with_position(lines: DataFrame) -> DataFrame:
    """lines plus position within conv_id, a long transcript over many tasks.

    Rows are sorted over range partitions, whose bounds hold no text, and counted within each; what a transcript
    has in earlier partitions is added. Rows equal in all of the order are in one partition."""
    order = ["conv_id", "turn", "tie", "line"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, k = TaskContext.get().partitionId(), object(), -1
        for batch in batches:
            numbers = []
            for conv in batch.column("conv_id").to_pylist():
                k = k + 1 if conv == current else 0
                current = conv
                numbers.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())], names=[*batch.schema.names, "_part", "_k"])

    schema = T.StructType([*lines.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_k", T.LongType())])
    counted = stored(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, schema))
    sizes = counted.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part")) - F.col("_n")
    starts = sizes.select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), before.alias("_before"))
    joined = counted.join(starts, counted.conv_id.eqNullSafe(starts["_c"]) & (counted["_part"] == starts["_p"]))
    return joined.select(*lines.columns, (F.col("_k") + F.col("_before")).alias("position"))


def line_features(lines: DataFrame) -> DataFrame:
    """lines (conv_id, turn, tie, line, text, state) plus FEATURES (strings) and position, counted from 0 in order of
    turn, tie and line within conv_id (null turns first)."""
    text = F.col("text")
    size = F.floor(F.log2(F.length(text) + 1)).cast("string")
    form = F.concat(
        F.when(text.rlike(r"\?\s*$"), "?").when(text.rlike(r"[.!]\s*$"), ".").otherwise("-"), F.when(text.contains("```"), "c").otherwise(""),
        F.when(ascii_lower(text).rlike(r"^\W*(you are|act as|always|never|follow)\b"), "s").otherwise(""),
    )
    placed = with_position(lines)
    place = F.when(F.col("position") == 0, "first").when(F.col("position") == 1, "second").otherwise("later")
    return placed.withColumns({"marker": marker_role(text), "size": size, "place": place, "form": form})


class RoleModel:
    """Log-probabilities of first states, state pairs and features by state; roles are the states' names."""

    def __init__(self, roles: list[str], first: np.ndarray, step: np.ndarray, emit: dict[tuple[str, str], np.ndarray], unseen: dict[str, np.ndarray]):
        self.roles, self.first, self.step, self.emit, self.unseen = roles, first, step, emit, unseen

    def emissions(self, columns: dict[str, list[str]]) -> np.ndarray:
        n = len(next(iter(columns.values())))
        out = np.zeros((n, len(self.roles)))
        for name, values in columns.items():
            default = self.unseen[name]
            out += np.array([self.emit.get((name, v), default) for v in values]).reshape(n, -1)
        return out


def fit(featured: DataFrame, smoothing: float = 0.5) -> RoleModel:
    """Counts over every line with a state; roles never seen cannot be predicted. Without any the model knows
    only `user`. More than MAX_ROLES roles are an error."""
    known = featured.where(F.col("state").isNotNull())
    last = featured.select(F.col("conv_id").alias("c"), (F.col("position") + 1).alias("p"), F.col("state").alias("before"))
    pairs = known.join(last, known.conv_id.eqNullSafe(last.c) & (known.position == last.p), "left")
    seen = [r[0] for r in known.select(F.left("state", F.length("state") - 1).alias("role")).distinct().limit(MAX_ROLES + 1).collect()]
    if len(seen) > MAX_ROLES:
        raise ValueError("the roles are over MAX_ROLES")
    roles = sorted(r + how for r in seen or ["user"] for how in (_BEGINS, _GOES_ON))
    steps = pairs.groupBy("before", F.col("state").alias("role")).agg(F.count("*").alias("n"), F.count_if(F.col("position") == 0).alias("starts")).collect()
    number = {r: i for i, r in enumerate(roles)}
    first, step = np.full(len(roles), smoothing), np.full((len(roles), len(roles)), smoothing)
    for r in steps:
        first[number[r.role]] += r.starts
        if r.before is not None:
            step[number[r.before], number[r.role]] += r.n
    feature = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("f")
    counted = known.select(F.col("state").alias("role"), feature).groupBy("role", "f.feature", "f.value").agg(F.count("*").alias("n")).collect()  # few values each
    tables: dict[tuple[str, str], np.ndarray] = {}
    totals = {f: np.full(len(roles), smoothing) for f in FEATURES}
    for r in counted:
        tables.setdefault((r.feature, r.value), np.full(len(roles), smoothing))[number[r.role]] += r.n
    for (f, _), n in tables.items():
        totals[f] = totals[f] + n
    emit = {k: np.log(n / totals[k[0]]) for k, n in tables.items()}
    return RoleModel(roles, np.log(first / first.sum()), np.log(step / step.sum(axis=1, keepdims=True)), emit, {f: np.log(smoothing / t) for f, t in totals.items()})


def _chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product: best scores over the role in between."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _best_path(matrices: list[np.ndarray], start: np.ndarray, last: int | None) -> list[int]:
    """Best states after each matrix from scores of the state before them; ending in last if given."""
    scores, back = start, []
    for m in matrices:
        ways = scores[:, None] + m
        back.append(ways.argmax(axis=0))
        scores = ways.max(axis=0)
    state = int(scores.argmax()) if last is None else last
    path = []
    for step in reversed(back):
        path.append(state)
        state = int(step[state])
    return path[::-1]


def by_group(df: DataFrame, keys: list[str], order: str, work, schema: str) -> DataFrame:
    """work, from a group's columns as lists to output columns as lists, on every group of equal keys
    (nulls equal) in order. Groups are met in sorted partitions, one at a time in memory."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] | None = None
        kinds = None

        def told(groups: list[dict[str, list]]) -> pa.RecordBatch:
            done = [work(g) for g in groups]
            columns = {n: [v for d in done for v in d[n]] for n in names}
            return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[n]) for n in names], names=names)

        for batch in batches:
            kinds = kinds or {n: batch.schema.field(n).type if n in batch.schema.names else _ARROW[part.split(None, 1)[1]] for n, part in zip(names, schema.split(", "), strict=True)}
            columns = batch.to_pydict()
            if kept:
                columns = {k: kept[k] + v for k, v in columns.items()}
            ids = list(zip(*(columns[k] for k in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
            groups = [{k: v[a:b] for k, v in columns.items()} for a, b in zip(cuts, cuts[1:], strict=False)]
            kept = {k: v[cuts[-1] :] for k, v in columns.items()} if ids else kept
            if groups:
                yield told(groups)
        if kept:
            yield told([kept])

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def decode(featured: DataFrame, model: RoleModel) -> DataFrame:
    """featured plus state_pred, by Viterbi over each conv_id in order of position."""
    k = len(model.roles)
    kind = featured.schema["conv_id"].dataType.simpleString()

    def line_matrices(rows: dict[str, list]) -> list[np.ndarray]:
        emissions = model.emissions({f: rows[f] for f in FEATURES})
        return [(np.tile(model.first, (k, 1)) if p == 0 else model.step) + e for p, e in zip(rows["position"], emissions, strict=True)]

    def product(matrices: list[np.ndarray]) -> list[float]:
        total = matrices[0]
        for m in matrices[1:]:
            total = _chain(total, m)
        return total.ravel().tolist()

    def squares(rows: dict[str, list]) -> list[np.ndarray]:
        return [np.array(m).reshape(k, k) for m in rows["matrix"]]

    def scores_of(entry: int | None) -> np.ndarray:
        return np.zeros(k) if entry is None else np.where(np.arange(k) == entry, 0.0, -np.inf)

    def reduce_chunk(rows):
        return {"conv_id": rows["conv_id"][:1], "number": rows["chunk"][:1], "matrix": [product(line_matrices(rows))]}

    def reduce_group(rows):
        return {"conv_id": rows["conv_id"][:1], "number": rows["group"][:1], "matrix": [product(squares(rows))]}

    def open_up(rows):
        """The role before and at the end of each matrix of a group between the group's own two roles."""
        path = _best_path(squares(rows), scores_of(rows["entry"][0]), rows["last"][0])
        return {"conv_id": rows["conv_id"], "number": rows["number"], "entry": [rows["entry"][0], *path[:-1]], "last": path}

    def decode_chunk(rows):
        path = _best_path(line_matrices(rows), scores_of(rows["entry"][0]), rows["last"][0])
        return {"conv_id": rows["conv_id"], "position": rows["position"], "state_pred": [model.roles[i] for i in path]}

    own = stored(featured.withColumn("chunk", F.floor(F.col("position") / CHUNK).cast("long")))
    narrow = own.select("conv_id", "chunk", "position", *FEATURES)
    shape = f"conv_id {kind}, number long, matrix array<double>"
    levels = [stored(by_group(narrow, ["conv_id", "chunk"], "position", reduce_chunk, shape))]
    grouped = lambda level: level.withColumn("group", F.floor(F.col("number") / FAN).cast("long"))
    most = narrow.agg(F.max("chunk")).first()[0] or 0
    while most >= FAN:
        levels.append(stored(by_group(grouped(levels[-1]), ["conv_id", "group"], "number", reduce_group, shape)))
        most //= FAN

    ends = None
    for level in reversed(levels):
        held = grouped(level)
        if ends is None:
            held = held.withColumns({"entry": F.lit(None).cast("long"), "last": F.lit(None).cast("long")})
        else:
            above = ends.select(F.col("conv_id").alias("c"), F.col("number").alias("g"), "entry", "last")
            held = held.join(above, held.conv_id.eqNullSafe(above.c) & (held.group == above.g)).drop("c", "g")
        ends = stored(by_group(held, ["conv_id", "group"], "number", open_up, f"conv_id {kind}, number long, entry long, last long"))

    inner = ends.select(F.col("conv_id").alias("c"), F.col("number").alias("n"), "entry", "last")
    ready = narrow.join(inner, narrow.conv_id.eqNullSafe(inner.c) & (narrow.chunk == inner.n)).drop("c", "n")
    found = by_group(ready, ["conv_id", "chunk"], "position", decode_chunk, f"conv_id {kind}, position long, state_pred string")
    found = found.select(F.col("conv_id").alias("c"), F.col("position").alias("p"), "state_pred")
    return own.join(found, own.conv_id.eqNullSafe(found.c) & (own.position == found.p)).drop("c", "p")


def turns(decoded: DataFrame) -> DataFrame:
    """(conv_id, turn, position, role, rendered) from decode's lines: a row for each run of lines from a beginning or
    another role on, numbered from 0 within conv_id, with the position of its first line."""
    begins = F.col("state_pred").endswith(_BEGINS) | (F.col("position") == 0)
    role = F.left("state_pred", F.length("state_pred") - 1)
    last = Window.partitionBy("conv_id", "chunk").orderBy("position")
    lines = decoded.select("conv_id", "chunk", "position", role.alias("role"), begins.cast("int").alias("begins"), "text")
    # beginnings of the chunks before a line's own, then those within it
    sums = lines.groupBy("conv_id", "chunk").agg(F.sum("begins").alias("n"))
    before = sums.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("chunk")) - F.col("n")).alias("before"))
    numbered = lines.withColumn("own", F.sum("begins").over(last)).join(before, lines.conv_id.eqNullSafe(before.c) & (lines.chunk == before.k))
    body = F.when(F.col("begins") == 1, F.coalesce(without_marker(F.col("text")), F.lit(""))).otherwise(F.col("text"))
    grouped = numbered.select("conv_id", (F.col("before") + F.col("own") - 1).alias("turn"), "position", "role", body.alias("body"))
    found = grouped.groupBy("conv_id", "turn").agg(F.min("position").alias("position"), F.min_by("role", "position").alias("role"), F.sort_array(F.collect_list(F.struct("position", "body"))).alias("lines"))
    text = F.trim(F.array_join(F.transform("lines", lambda x: x["body"]), "\n"))
    return found.select("conv_id", "turn", "position", "role", F.concat(F.lit(_OPEN), F.col("role"), F.lit("\n"), text, F.lit(_CLOSE)).alias("rendered"))


def parse_transcripts(transcripts: DataFrame, model: RoleModel) -> DataFrame:
    """turns of transcripts (conv_id, text) that are whole texts, by a model of other transcripts.

    Null text is one empty line; rows of one conv_id (nulls are one) follow each other by a hash of the text; long
    texts are parsed whole; an empty table gives an empty one; other columns are ignored.
    """
    return turns(decode(line_features(text_lines(transcripts.select("conv_id", "text"))), model))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, held_out, turn, position, role, rendered): the transcripts of conversations (conv_id, turn, role, text)
    parsed back into turns, in canonical rendering.

    Only conversations whose crc32(conv_id as text) mod 5 is not 1 teach the model, and no role is ever copied to a
    line. Null text is an empty line; rows with a null conv_id are one conversation; turns of one number go by a hash
    of role and text; repeated rows are repeated turns; long texts are parsed whole; an empty table gives an empty
    one; other columns are ignored.
    """
    featured = stored(line_features(transcript_lines(conversations.select("conv_id", "turn", "role", "text"))))
    held_out = remainder(F.col("conv_id"), 5) == 1
    found = turns(decode(featured.drop("state"), fit(featured.where(~held_out))))
    return found.select("conv_id", held_out.alias("held_out"), "turn", "position", "role", "rendered")
