"""Alignment and similarity of pairs: Spark makes, prunes and spreads the pairs, numpy fills the matrices.

A matrix row follows from the one before in whole-row operations: the best of diagonal and upper
neighbour, then a running maximum for gaps along the row. Distinct pairs of texts are aligned once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import refdata
from strandlake.functions.sizes import SMALL_ROWS, broadcast_if_small
from strandlake.functions.storage import kept
from strandlake.functions.tables import local_table
from strandlake.operators import chunks

MATCH, MISMATCH, GAP = 2, -1, -2
#: Places of a pair's matrix that are held at a time, and parts into which a larger one is cut. Never change a result.
CELLS, PARTS = 8_000_000, 64


def substitution(kind: str = "nucleotide", zero_fix: bool = False) -> np.ndarray:
    """Scores by character code; protein scores of 0 count as -1, as unknown ones do, without zero_fix."""
    out = np.full((128, 128), MISMATCH, np.int32)
    if kind == "nucleotide":
        np.fill_diagonal(out, MATCH)
    else:
        for (a, b), v in refdata.blosum62().items():
            out[ord(a), ord(b)] = v if v or zero_fix else -1
    return out


class _Rows:
    """Rows of a pair's matrix, made one after another: h[i] from h[i - 1] in whole-row operations."""

    def __init__(self, a: str, b: str, scores: np.ndarray, local: bool):
        code = lambda s: np.minimum(np.frombuffer(s.encode("utf-32-le"), np.uint32), 127).astype(np.int64)
        own, letters, self.local = code(b), code(a), local
        kinds, self.kind = np.unique(letters, return_inverse=True)
        self.profile = scores[kinds][:, own]  # scores of a letter of a against all of b, a row for each kind of letter
        self.ramp = -GAP * np.arange(len(b) + 1, dtype=np.int32)

    def first(self, width: int) -> np.ndarray:
        return np.zeros(width, np.int32) if self.local else -self.ramp[:width]

    def pair(self, i: int) -> np.ndarray:
        """Scores of letter i (from 1) of a against all of b."""
        return self.profile[self.kind[i - 1]]

    def following(self, i: int, above: np.ndarray) -> np.ndarray:
        """Row i of as many columns as row i - 1."""
        row, n = np.empty(len(above), np.int32), len(above) - 1
        row[0] = 0 if self.local else GAP * i
        np.maximum(above[:-1] + self.pair(i)[:n], above[1:] + GAP, out=row[1:])
        if self.local:
            np.maximum(row, 0, out=row)
        row += self.ramp[: n + 1]
        np.maximum.accumulate(row, out=row)
        row -= self.ramp[: n + 1]
        return row


def _back(rows: _Rows, lo: int, top: np.ndarray, i: int, j: int, cells: int) -> tuple[int, int, str, bool]:
    """Goes back from (i, j) to row lo, whose values top holds: where the path then is, its steps (d: both letters, a: a
    gap in b, b: a gap in a), and whether it ended.

    Few enough rows are made whole. More are cut into parts: only the rows at which parts begin are kept, and the
    parts are gone through from the last one on, each in the same way."""
    top, steps, ended = top[: j + 1], [], False
    if (i - lo + 1) * (j + 1) <= cells or i - lo <= 1:
        h = [top]
        for k in range(lo + 1, i + 1):
            h.append(rows.following(k, h[-1]))
        while True:
            here = h[i - lo][j]
            ended = (here == 0 or not i or not j) if rows.local else not (i or j)
            if ended or i == lo > 0:
                break
            if i and j and here == h[i - lo - 1][j - 1] + rows.pair(i)[j - 1]:
                i, j = i - 1, j - 1
                steps.append("d")
            elif i and here == h[i - lo - 1][j] + GAP:
                i -= 1
                steps.append("a")
            else:
                j -= 1
                steps.append("b")
        return i, j, "".join(steps), ended
    count = min(PARTS, i - lo)
    starts = [lo + (i - lo) * k // count for k in range(count)]
    tops, row = {lo: top}, top
    for start, after in zip(starts, starts[1:], strict=False):
        for k in range(start + 1, after + 1):
            row = rows.following(k, row)
        tops[after] = row
    while starts and not ended:
        i, j, more, ended = _back(rows, starts[-1], tops.pop(starts.pop()), i, j, cells)
        steps.append(more)
    return i, j, "".join(steps), ended


def align(a: str, b: str, scores: np.ndarray, local: bool = False, cells: int | None = None) -> tuple[int, str, str, int, int]:
    """(score, aligned a, aligned b, start in a, start in b) of the upper-cased texts.

    Going back, the diagonal is preferred, then a gap in b, then a gap in a; a local alignment starts
    from the first greatest cell in row order and ends at 0. Memory is that of about cells places and PARTS rows
    for each level of parts, whatever the lengths; a matrix of more is made anew for each level but the first."""
    a, b = a.upper(), b.upper()
    m, n, cells = len(a), len(b), CELLS if cells is None else cells
    if not m or not n:
        return (0, "", "", 0, 0) if local else (GAP * (m + n), a + "-" * n, "-" * m + b, 0, 0)
    rows = _Rows(a, b, scores, local)
    i, j, top = m, n, rows.first(n + 1)
    if local:
        best, row, i, j = 0, top, 0, 0
        for k in range(1, m + 1):
            row = rows.following(k, row)
            at = int(row.argmax())
            if row[at] > best:
                best, i, j = int(row[at]), k, at
    end = i, j
    i, j, steps, _ = _back(rows, 0, top, i, j, cells)
    x, y, at, to = [], [], i, j
    for step in reversed(steps):
        x.append("-" if step == "b" else a[at])
        y.append("-" if step == "a" else b[to])
        at, to = at + (step != "b"), to + (step != "a")
    assert (at, to) == end
    return best if local else _score(x, y, scores), "".join(x), "".join(y), i, j


def _score(x: list[str], y: list[str], scores: np.ndarray) -> int:
    """The score of two rows of an alignment."""
    code = lambda c: min(ord(c), 127)
    return sum(GAP if p == "-" or q == "-" else int(scores[code(p), code(q)]) for p, q in zip(x, y, strict=True))


def _aligned(pairs: DataFrame, scores: np.ndarray, local: bool) -> DataFrame:
    """pairs (seq_a, seq_b and others) plus score, aligned_a, aligned_b, start_a, start_b, pairs of about one size dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [align(a, b, scores, local) for a, b in zip(batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist(), strict=True)]
            parts = list(zip(*done, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p, k) for p, k in zip(parts, kinds, strict=True))], names=[*batch.schema.names, "score", "aligned_a", "aligned_b", "start_a", "start_b"])

    cells = F.floor(F.log2((F.length("seq_a") + 1) * (F.length("seq_b") + 1)))
    spread = pairs.repartition(cells, F.pmod(F.xxhash64("seq_a", "seq_b"), F.lit(64)))
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return spread.mapInArrow(run, f"{own}, score int, aligned_a string, aligned_b string, start_a int, start_b int")


def align_pairs(pairs: DataFrame, method: str = "global", kind: str = "nucleotide", zero_fix: bool = False) -> DataFrame:
    """pairs (id_a, id_b, seq_a, seq_b) plus score, aligned_a, aligned_b, start_a, start_b, identity, gaps."""
    done = _aligned(pairs.select("seq_a", "seq_b").distinct(), substitution(kind, zero_fix), method == "local")
    return alignment_stats(pairs.join(done, ["seq_a", "seq_b"]))


def alignment_stats(aligned: DataFrame) -> DataFrame:
    """aligned (aligned_a, aligned_b) plus identity (percent of columns without a gap), gaps and line."""
    columns = F.when(F.col("aligned_a") == "", F.array().cast("array<string>")).otherwise(
        F.zip_with(F.split("aligned_a", ""), F.split("aligned_b", ""), lambda a, b: F.when((a == "-") | (b == "-"), " ").when(F.upper(a) == F.upper(b), "|").otherwise("·")))
    line = F.array_join(columns, "")
    own = aligned.withColumn("line", line)
    count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    matched, gaps = count("|"), count(" ")
    return own.withColumns({"identity": F.when(F.length("line") > gaps, 100.0 * matched / (F.length("line") - gaps)).otherwise(0.0), "gaps": gaps})


def consensus(rows: DataFrame) -> DataFrame:
    """(grp, consensus) of aligned rows (grp, seq_id, aligned): most frequent letter of each column but gaps;
    the first row's on ties; - where all are gaps."""
    cells = rows.select("grp", "seq_id", F.posexplode(F.split(F.upper("aligned"), "")).alias("at", "c")).where("c <> ''")
    counts = cells.groupBy("grp", "at", "c").agg(F.count("*").alias("n"), F.min("seq_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("grp", "at").orderBy(F.col("c") == "-", F.desc("n"), "first"))
    best = counts.withColumn("rank", rank).where("rank = 1")
    return best.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]), "").alias("consensus"))


def pairs_within(seqs: DataFrame) -> DataFrame:
    """(grp, id_a, id_b, seq_a, seq_b) for id_a < id_b of a group."""
    a = seqs.select("grp", F.col("seq_id").alias("id_a"), F.col("sequence").alias("seq_a"))
    b = seqs.select("grp", F.col("seq_id").alias("id_b"), F.col("sequence").alias("seq_b"))
    return a.join(b, "grp").where("id_a < id_b")


def pairwise_distances(seqs: DataFrame) -> DataFrame:
    """(grp, id_a, id_b, distance): 1 - identity / 100 of the global nucleotide alignment."""
    return align_pairs(pairs_within(seqs)).select("grp", "id_a", "id_b", (1 - F.col("identity") / 100).alias("distance"))


def star_alignment(seqs: DataFrame, reference_id: int) -> DataFrame:
    """(seq_id, aligned): every sequence aligned to the reference, insertions of all merged.

    A place of the reference gets as many insertion columns as its longest insertion in any row."""
    reference = seqs.where(F.col("seq_id") == reference_id).select(F.col("seq_id").alias("id_a"), F.col("sequence").alias("seq_a")).limit(1)
    pairs = F.broadcast(reference).crossJoin(seqs.select(F.col("seq_id").alias("id_b"), F.col("sequence").alias("seq_b")))  # one row
    # the gaps before the first letter of the reference, then each of its letters with the gaps after it
    runs = F.concat(F.array(F.regexp_extract("aligned_a", "^-*", 0)), F.regexp_extract_all("aligned_a", F.lit("[^-]-*"), F.lit(0)))
    each = align_pairs(pairs).select("id_b", "aligned_b", F.posexplode(F.transform(runs, F.length)).alias("ref", "size"))
    end = F.sum("size").over(Window.partitionBy("id_b").orderBy("ref"))
    parts = each.withColumn("part", F.substr("aligned_b", (end - F.col("size") + 1).cast("int"), F.col("size"))).select("id_b", "ref", "part")
    widths = parts.groupBy("ref").agg(F.max(F.length("part")).alias("width"))
    filled = parts.join(widths, "ref").select("id_b", F.struct("ref", F.rpad("part", F.col("width"), F.lit("-")).alias("part")).alias("cell"))
    return filled.groupBy(F.col("id_b").alias("seq_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("cell")), lambda x: x["part"]), "").alias("aligned"))


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """Distinct (seq_id, kmer)."""
    return chunks.positioned_words(seqs, k).select("seq_id", F.col("word").alias("kmer")).distinct()


#: Targets of one word that a task joins; those of a word that more share are dealt out by their ids.
HOT_WORD = 1000


def _words_small(words: DataFrame) -> bool:
    """Whether the words may be held by every task."""
    return words.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


#: Letters whose words are looked up at a time. Never changes a result.
LOOKED_UP = 100_000
_FACTOR, _SPREAD = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15


def _hashes(codes: np.ndarray, size: int, held: dict[int, np.ndarray]) -> np.ndarray:
    """Hashes of the size letters from each place of the codes on; held has those of other sizes at hand."""
    if size == 1:
        return codes
    if size not in held:
        half = size // 2
        x, n = _hashes(codes, half, held), max(0, len(codes) - size + 1)
        out = x[:n] * np.uint64(pow(_FACTOR, half, 1 << 64)) + x[half : half + n]
        held[size] = out * np.uint64(_FACTOR) + codes[size - 1 : size - 1 + n] if size % 2 else out
    return held[size]


def _letters(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts as one, the hash of each letter, and where each text begins and the last one ends."""
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    codes *= np.uint64(_SPREAD)
    return whole, codes ^ (codes >> np.uint64(29)), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _found(targets: DataFrame, known: dict[int, list[str]], counted: bool = False) -> DataFrame:
    """(seq_id, pos, size, word): places of the upper-cased targets with one of the known words, by their numbers of letters;
    or with counted (size, word, n), how many, as each task has them. Words are met by hash, so a join with them may follow."""
    own = chunks.with_halo(targets.withColumn("sequence", F.upper("sequence")), chunks.CHUNK, max(known) - 1).select("seq_id", "start", "core", "sequence")
    tables = {}
    for size, words in known.items():
        _, codes, ends = _letters(words)
        of = _hashes(codes, size, {})[ends[:-1]] if words else np.zeros(0, np.uint64)
        order, seen = np.argsort(of), np.zeros(1 << 20, bool)
        seen[(of * np.uint64(_SPREAD)) >> np.uint64(44)] = True
        tables[size] = of[order], order, seen
    words = {size: np.array(v, object) for size, v in known.items()}

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pa.compute.utf8_length(batch.column(3)).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + LOOKED_UP, "right")))
                yield batch.slice(lo, hi - lo)
                lo = hi

    def places(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each size the rows of the batch, places in them and in all, and numbers of the words."""
        _, codes, ends = _letters(batch.column(3).to_pylist())
        core, held = batch.column(2).to_numpy(), {}
        for size, (of, order, seen) in tables.items():
            h = _hashes(codes, size, held)
            at = np.flatnonzero(seen[(h * np.uint64(_SPREAD)) >> np.uint64(44)])
            number = np.searchsorted(of, h[at])
            same = number < len(of)
            same[same] = of[number[same]] == h[at[same]]
            at, number = at[same], number[same]
            row = np.searchsorted(ends, at, "right") - 1
            inside = (at + size <= ends[row + 1]) & (at - ends[row] < core[row])
            yield size, row[inside], (at - ends[row])[inside], at[inside], order[number[inside]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {size: np.zeros(len(v), np.int64) for size, v in words.items()}
        for batch in batches:
            for part in parts([batch]):
                for size, _, _, _, number in places(part):
                    n[size] += np.bincount(number, minlength=len(n[size]))
        for size, v in n.items():
            has = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), size), pa.int32()), pa.array(words[size][has], pa.string()), pa.array(v[has])], names=["size", "word", "n"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            for size, row, place, _, number in places(part):
                pos = part.column(1).to_numpy()[row] + place
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(np.full(len(row), size), pa.int32()), pa.array(words[size][number], pa.string())], names=["seq_id", "pos", "size", "word"])

    if counted:
        return own.mapInArrow(count, "size int, word string, n long")
    return own.mapInArrow(tell, f"seq_id {own.schema['seq_id'].dataType.simpleString()}, pos int, size int, word string")


def candidate_pairs(queries: DataFrame, targets: DataFrame, k: int = 11, min_shared: int = 2) -> DataFrame:
    """(id_a, id_b, shared): pairs of different ids that share min_shared words of k letters or more.

    Few queries' words go to every task, so no other words of the targets are shuffled."""
    q = kmers(queries, k).withColumnRenamed("seq_id", "id_a")
    if _words_small(q):
        asked = q.select("kmer").distinct()
        words = _found(targets, {k: [r.kmer for r in asked.collect()]}).select(F.col("seq_id").alias("id_b"), F.col("word").alias("kmer"))
        t = words.join(F.broadcast(asked), "kmer", "left_semi").distinct()
        shared = t.join(F.broadcast(q), "kmer").where("id_a <> id_b")
    else:
        t = kmers(targets, k).withColumnRenamed("seq_id", "id_b")
        hot = t.groupBy("kmer").agg(F.ceil(F.count("*") / HOT_WORD).cast("int").alias("deals")).where("deals > 1")
        deals = F.coalesce("deals", F.lit(1))
        dealt = t.join(hot, "kmer", "left").select("id_b", "kmer", F.pmod(F.xxhash64("id_b"), deals).cast("int").alias("deal"))
        every = q.join(hot, "kmer", "left").select("id_a", "kmer", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
        shared = every.join(dealt, ["kmer", "deal"]).where("id_a <> id_b")
    return shared.groupBy("id_a", "id_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)


#: Places of the matrices' diagonals that are filled side by side, and letters of a longer text that go as one piece (with
#: those that an alignment can reach from it). Neither changes a result.
SIDE_BY_SIDE, PIECE = 131_072, 1_024
#: Kinds of number for scores, what stands for 0 in them, and the most that they hold.
KINDS = ((np.int8, -120, 240), (np.int16, -32_000, 64_000), (np.int32, 0, 2**31 - 1_000))


def local_scores(pairs: list[tuple[str, str]], scores: np.ndarray) -> np.ndarray:
    """The local scores that align gives for the pairs' texts: matrices of pairs of about one size side by side, diagonal by
    diagonal, so that no place waits for another one of its diagonal, in the smallest numbers that hold the scores.

    A local alignment reaches over few more letters of one text than the other has, as gaps cost; so a long text goes in
    pieces that overlap by so many, and the best one counts."""
    top, plain = max(int(scores.max()), 0), bool((scores == substitution()).all())
    out, texts = np.zeros(len(pairs), np.int32), [(_bytes(a), _bytes(b)) for a, b in pairs]
    if (scores == scores.T).all():
        texts = [(a, b) if len(a) <= len(b) else (b, a) for a, b in texts]
    pieces = []
    for x, (a, b) in enumerate(texts):
        more = len(a) + top * len(a) // -GAP
        if len(a) and len(b):
            pieces += [(-(-len(a) // 8), min(len(b) - at, PIECE + more), x, at) for at in range(0, max(1, len(b) - more), PIECE)]
    pieces.sort()
    # codes that stand behind the texts' ends and equal nothing
    padded = np.full((130, 130), MISMATCH, np.int32)
    padded[:128, :128] = scores
    while pieces:
        now = pieces[: max(1, SIDE_BY_SIDE // (8 * pieces[0][0]))]
        now = [p for p in now if p[0] == now[0][0]]
        pieces = pieces[len(now) :]
        m, n = max(len(texts[x][0]) for _, _, x, _ in now), now[-1][1]
        kind, zero, _ = next(k for k in KINDS if top * m <= k[2])
        a, b = np.full((len(now), m), 128, np.uint8), np.full((len(now), n + 2 * m), 129, np.uint8)
        for k, (_, size, x, at) in enumerate(now):
            a[k, : len(texts[x][0])] = texts[x][0]
            b[k, m + n - size : m + n] = texts[x][1][at : at + size][::-1]
        # a column for each pair; row i of a diagonal holds letter i of a against the letter of b as far back as i
        a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        two, one, row = (np.full((m + 1, len(now)), zero, kind) for _ in range(3))
        none, best, gain = (np.full((m, len(now)), zero, kind) for _ in range(3))
        equal = np.empty(a.shape, bool)
        lead, step = (MATCH - MISMATCH, GAP - MISMATCH) if plain else (0, GAP)
        for d in range(m + n - 1):
            here, against = row[1:], b[m + n - 1 - d : 2 * m + n - 1 - d]
            if plain:
                np.multiply(np.equal(a, against, out=equal).view(np.int8), kind(lead), out=gain)
            else:
                gain[:] = padded[a, against]
            gain += two[:-1]
            np.maximum(one[1:], one[:-1], out=here)
            here += kind(step)
            np.maximum(here, gain, out=here)
            if plain:
                here += kind(MISMATCH)
            np.maximum(here, none, out=here)
            np.maximum(best, here, out=best)
            two, one, row = one, row, two
        np.maximum.at(out, [x for _, _, x, _ in now], best.max(axis=0).astype(np.int32) - zero)
    return out


def search_similar(queries: DataFrame, targets: DataFrame, k: int = 11, min_shared: int = 2, top: int = 20) -> DataFrame:
    """The best local alignments of each query among its candidates: score, identity, coverage, rank.

    Of every candidate the score is made first, and only the best ones are aligned; texts are shuffled once."""
    found, scores = candidate_pairs(queries, targets, k, min_shared), substitution()
    a = queries.select(F.col("seq_id").alias("id_a"), F.col("sequence").alias("seq_a"))
    b = targets.select(F.col("seq_id").alias("id_b"), F.col("sequence").alias("seq_b"))
    ids = {f.name: f.dataType.simpleString() for f in found.schema}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = local_scores(list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)), scores)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.int32())], names=["id_a", "id_b", "shared", "score"])

    texts = found.join(b, "id_b").join(broadcast_if_small(a, HOT_WORD), "id_a").select("id_a", "id_b", "shared", "seq_a", "seq_b")
    scored = texts.mapInArrow(score, ", ".join(f"{c} {t}" for c, t in ids.items()) + ", score int")
    rank = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    # aligned as they come: a second use of best would score all pairs again
    done = alignment_stats(_aligned(best.drop("score").join(a, "id_a").join(b, "id_b"), scores, True))
    covered = F.length(F.replace("aligned_a", F.lit("-"), F.lit("")))
    return done.select("id_a", "id_b", "shared", "score", "identity", (100.0 * covered / F.length("seq_a")).alias("coverage"), "rank")


#: Target places of one seed up to which it is joined; commoner seeds are replaced by longer ones from the same places.
HOT_SEED = 1000
#: Lengths of seeds, as multiples of k: the last one is joined however common it is, dealt out over tasks.
SEED_LENGTHS = (1, 2, 4)
#: Diagonals that chain seeds, what a band has besides on either side, and how far an extension's score may drop.
CHAIN_SHIFT, BAND_MARGIN, DROP_OFF = 12, 24, 40
#: Places of the bands that are filled side by side.
BAND_CELLS = 60_000


def _seeds(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(id_a, id_b, at_a, at_b, size): places that share a word of k letters, or of more where that is too common.

    Few queries' words of all lengths go to every task: the targets are read once to count them, and once for the places
    of those that then are seeds."""
    sizes = [k * times for times in SEED_LENGTHS]
    asked = reduce(DataFrame.union, [chunks.positioned_words(queries, size).withColumn("size", F.lit(size)) for size in sizes])
    if not _words_small(asked):
        return _joined_seeds(queries, targets, k)
    known, hot = {size: set() for size in sizes}, set()
    for r in asked.select("size", "word").distinct().collect():
        known[r.size].add(r.word)
    for r in _found(targets, {size: sorted(v) for size, v in known.items()}, True).groupBy("size", "word").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_SEED).select("word").collect():
        hot.add(r.word)
    # a word is a seed if all shorter ones that it begins with are too common, and it is not, or is of the last length
    seeds = {size: sorted(w for w in known[size] if (size == sizes[-1] or w not in hot) and all(w[:s] in hot for s in sizes if s < size)) for size in sizes}
    words = local_table(queries.sparkSession, [(size, w) for size, v in seeds.items() for w in v], "size int, word string")
    places = _found(targets, seeds).join(F.broadcast(words), ["size", "word"], "left_semi")
    a = asked.join(F.broadcast(words), ["size", "word"], "left_semi").select("size", "word", F.col("seq_id").alias("id_a"), F.col("pos").alias("at_a"))
    met = places.join(F.broadcast(a), ["size", "word"])
    return met.select("id_a", F.col("seq_id").alias("id_b"), "at_a", F.col("pos").alias("at_b"), "size")


def _joined_seeds(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """_seeds of any number of queries, by joins."""
    out, q_hot, t_hot = None, None, None
    for times in SEED_LENGTHS:
        size, last = k * times, times == SEED_LENGTHS[-1]
        q, t = chunks.positioned_words(queries, size), chunks.positioned_words(targets, size)
        words = q.select("word").distinct()
        t = t.join(broadcast_if_small(words), "word", "left_semi")  # no other words are counted or shuffled
        if q_hot is not None:
            longer = lambda rows, hot: rows.withColumn("shorter", F.left("word", F.lit(hot[1]))).join(hot[0], "shorter", "left_semi").drop("shorter")
            q, t = longer(q, q_hot), longer(t, t_hot)
        counts = t.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEED)
        if last:
            deals = F.coalesce(F.ceil(F.col("n") / HOT_SEED).cast("int"), F.lit(1))
            dealt = t.join(counts, "word", "left").withColumn("deal", F.pmod(F.xxhash64("seq_id", "pos"), deals).cast("int"))
            every = q.join(counts, "word", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
        else:
            hot = broadcast_if_small(counts.select("word"))
            q_hot = t_hot = hot.withColumnRenamed("word", "shorter"), size
            dealt, every = (rows.join(hot, "word", "left_anti").withColumn("deal", F.lit(0)) for rows in (t, q))
        a = every.select("word", "deal", F.col("seq_id").alias("id_a"), F.col("pos").alias("at_a"))
        b = dealt.select("word", "deal", F.col("seq_id").alias("id_b"), F.col("pos").alias("at_b"))
        met = a.join(b, ["word", "deal"]).select("id_a", "id_b", "at_a", "at_b", F.lit(size).alias("size"))
        out = met if out is None else out.union(met)
    return out


def _chains(seeds: DataFrame, min_seeds: int) -> DataFrame:
    """(id_a, id_b, chain, seeds, low, high, last) of the pairs with enough seeds: those on diagonals (place in b minus place
    in a) that lie near each other make a chain, from low to high, and end at place last of a."""
    by_diagonal = seeds.groupBy("id_a", "id_b", (F.col("at_b") - F.col("at_a")).alias("diagonal")).agg(F.count("*").alias("n"), F.max(F.col("at_a") + F.col("size")).alias("last"))
    own = Window.partitionBy("id_a", "id_b").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(own) > CHAIN_SHIFT).cast("int"), F.lit(0))
    chained = by_diagonal.withColumns({"apart": apart, "all": F.sum("n").over(Window.partitionBy("id_a", "id_b"))}).where(F.col("all") >= min_seeds).withColumn("chain", F.sum("apart").over(own))
    return chained.groupBy("id_a", "id_b", "chain").agg(F.max("all").alias("seeds"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.max("last").alias("last"))


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127).astype(np.int64)


def _bytes(text: str) -> np.ndarray:
    """The codes of the upper-cased text in a byte each."""
    text = text.upper()
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else _codes(text).astype(np.uint8)


def band_scores(pairs: list[tuple[np.ndarray, np.ndarray, int, int]], width: int, scores: np.ndarray) -> np.ndarray:
    """Of pairs (codes a, codes b, lowest diagonal, last) the best local scores within width diagonals, all bands side by
    side. Rows end where, behind the last seed, every pair's score has dropped by over DROP_OFF."""
    m, n = (np.array([len(p[k]) for p in pairs])[:, None] for k in (0, 1))
    a, b = (np.full((len(pairs), max(1, int(size.max()))), 127) for size in (m, n))
    for k, p in enumerate(pairs):
        a[k, : len(p[0])], b[k, : len(p[1])] = p[0], p[1]
    low, last = (np.array([p[k] for p in pairs])[:, None] for k in (2, 3))
    c = np.arange(width)
    ramp, h, best = -GAP * c, np.zeros((len(pairs), width), np.int64), np.zeros((len(pairs), 1), np.int64)
    for i in range(1, int(m.max(initial=0)) + 1):
        j = c + (low + i)
        inside = (j >= 1) & (j <= n) & (i <= m)
        pair = scores[a[:, i - 1 : i], np.take_along_axis(b, np.clip(j - 1, 0, b.shape[1] - 1), axis=1)]
        row = np.maximum(h + pair, 0)
        np.maximum(row[:, :-1], h[:, 1:] + GAP, out=row[:, :-1])
        h = np.where(inside, np.maximum.accumulate(np.where(inside, row, 0) + ramp, axis=1) - ramp, 0)
        top = h.max(axis=1, keepdims=True)
        best = np.maximum(best, top)
        if not ((i < last) | (top >= best - DROP_OFF)).any():
            break
    return best[:, 0]


def align_band(a: np.ndarray, b: np.ndarray, scores: np.ndarray, low: int, width: int) -> tuple[int, int, int, int]:
    """(score, equal letters, columns without a gap, letters of a) of the best local alignment of letter codes within width
    diagonals from low on; ties as in align."""
    m, n, c = len(a), len(b), np.arange(width)
    h, ramp = np.zeros((m + 1, width), np.int32), -GAP * np.arange(width)
    for i in range(1, m + 1):
        j = c + (i + low)
        inside = (j >= 1) & (j <= n)
        row = np.maximum(h[i - 1] + scores[a[i - 1], b[np.clip(j - 1, 0, max(0, n - 1))]], 0) if n else np.zeros(width, np.int64)
        np.maximum(row[:-1], h[i - 1][1:] + GAP, out=row[:-1])
        h[i] = np.where(inside, np.maximum.accumulate(np.where(inside, row, 0) + ramp) - ramp, 0)
    i, k = divmod(int(h.argmax()), width)
    score, end, same, both = int(h[i, k]), i, 0, 0
    while i and h[i, k] > 0 and i + low + k > 0:
        j = i + low + k
        if h[i, k] == h[i - 1, k] + scores[a[i - 1], b[j - 1]]:
            same, both, i = same + int(a[i - 1] == b[j - 1]), both + 1, i - 1
        elif k + 1 < width and h[i, k] == h[i - 1, k + 1] + GAP:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return score, same, both, end - i


def search_seeded(queries: DataFrame, targets: DataFrame, k: int = 11, min_shared: int = 2, top: int = 20, kind: str = "nucleotide") -> DataFrame:
    """(id_a, id_b, seeds, score, identity, coverage, rank): the best local alignments of each query (seq_id, sequence).

    Seeds are shared words, longer where a word is too common, so that their pairs grow with the queries' places and not
    with the square of a word's sequences. Seeds on near diagonals make a chain. Of every chain the matrix is filled
    within its diagonals (and a margin), down to where the score drops behind its last seed; the best chains are then
    aligned within their band. Equal targets are aligned once, and each of them has its rank. search_similar
    aligns whole sequences without bands and so is the exact way."""
    scores = substitution(kind)
    text = F.upper("sequence").alias("sequence")
    # read and compared once: each text stands in the row of its first id
    equal = Window.partitionBy("sequence").orderBy("seq_id")
    first = targets.select("seq_id", text).withColumns({"name": F.first("seq_id").over(equal), "place": F.row_number().over(equal)})
    named = kept(first.select("seq_id", "name", "place", F.when(F.col("place") == 1, F.col("sequence")).alias("sequence")))
    once = named.where("place = 1").select("seq_id", "sequence")
    if once.groupBy("seq_id").count().where("count > 1").limit(1).count():
        once = once.dropDuplicates(["seq_id"])
    asked = queries.select("seq_id", text)
    a = asked.select(F.col("seq_id").alias("id_a"), F.col("sequence").alias("seq_a"))
    b = once.select(F.col("seq_id").alias("id_b"), F.col("sequence").alias("whole"))
    first, width = F.col("low") - BAND_MARGIN, F.col("high") - F.col("low") + 1 + 2 * BAND_MARGIN
    # no more of a target than the query can reach from the band
    start, stop = F.greatest(first, F.lit(0)), F.greatest(F.col("low") + width + F.length("seq_a"), F.lit(0))
    part = F.substr("whole", start + 1, stop - start)
    texts = lambda chains: chains.join(a, "id_a").join(b, "id_b").select(*chains.columns, "seq_a", part.alias("part"), (first - start).cast("int").alias("shift"), width.cast("int").alias("width"))
    chains = _chains(_seeds(asked, once, k), min_shared)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["seq_a", "part", "shift", "last", "width"]).to_pylist()
            best = np.zeros(len(rows), np.int64)
            # bands of about one width and height side by side
            size = lambda r: (r["width"].bit_length(), len(r["seq_a"]))
            order = sorted(range(len(rows)), key=lambda x: size(rows[x]))
            while order:
                wide = max(rows[x]["width"] for x in order[: max(1, BAND_CELLS // rows[order[0]]["width"])])
                now = [x for x in order[: max(1, BAND_CELLS // wide)] if size(rows[x])[0] == size(rows[order[0]])[0]]
                order = order[len(now) :]
                wide = max(rows[x]["width"] for x in now)
                best[now] = band_scores([(_codes(rows[x]["seq_a"]), _codes(rows[x]["part"]), rows[x]["shift"], rows[x]["last"]) for x in now], wide, scores)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(best.astype(np.int32))], names=[*names, "score"])

    def align_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                x = _codes(r["seq_a"])
                score, same, both, own = align_band(x, _codes(r["part"]), scores, r["shift"], r["width"])
                made.append((score, 100.0 * same / both if both else 0.0, 100.0 * own / len(x)))
            parts = list(zip(*made, strict=True)) or [[]] * 3
            new = [pa.array(p, t) for p, t in zip(parts, (pa.int32(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id_a", "id_b", "seeds")), *new], names=["id_a", "id_b", "seeds", "score", "identity", "coverage"])

    names, ids = chains.columns, {f.name: f.dataType.simpleString() for f in chains.schema}
    spread = texts(chains).repartition(F.xxhash64("id_a", "id_b", "chain"))
    filled = spread.mapInArrow(fill, ", ".join(f"{c} {ids[c]}" for c in names) + ", score int")
    each = filled.groupBy("id_a", "id_b").agg(F.max_by(F.struct("seeds", "low", "high", "last", "score"), F.struct("score", -F.col("chain"))).alias("c")).select("id_a", "id_b", "c.*")
    # a query's best texts, one more than asked for since the query itself may be among them, then all sequences of those
    order = lambda of: F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("score"), of))
    best = each.withColumn("rank", order("id_b")).where(F.col("rank") <= top + 1).drop("rank", "score")
    few = texts(kept(best)).repartition(2 * queries.sparkSession.sparkContext.defaultParallelism, "id_a", "id_b")
    done = few.mapInArrow(align_best, f"id_a {ids['id_a']}, id_b {ids['id_b']}, seeds long, score int, identity double, coverage double").withColumnRenamed("id_b", "name")
    copies = named.where(F.col("place") <= top + 1).select("name", F.col("seq_id").alias("id_b"))
    return done.join(copies, "name").where("id_a <> id_b").withColumn("rank", order("id_b")).where(F.col("rank") <= top).select("id_a", "id_b", "seeds", "score", "identity", "coverage", "rank")


def dot_plot(pairs: DataFrame, window: int = 10, threshold: float = 70.0) -> DataFrame:
    """(id_a, id_b, i, j, matches) of windows, on a grid of max(1, length // 300), with enough equal letters.

    Two windows with few unequal letters agree in one of as many blocks and one more, so windows on the grid are
    joined on those; a pair of windows is counted at the first block in which it agrees."""
    least = math.ceil(window * threshold / 100)
    blocks = min(window, window - least + 1)
    edges = [window * b // blocks for b in range(blocks + 1)]
    part = lambda w, b: F.substr(w, F.lit(edges[b] + 1), F.lit(edges[b + 1] - edges[b]))

    def windows(side: str, at: str) -> DataFrame:
        text = F.upper(f"seq_{side}")
        step = F.greatest(F.lit(1), F.floor(F.length(text) / 300).cast("int"))
        each = pairs.select("id_a", "id_b", step.alias("step"), F.posexplode(chunks.words_at(text, window)).alias(at, f"w{side}")).where(F.col(at) % F.col("step") == 0)
        words = F.array(*[part(f"w{side}", b) for b in range(blocks)])
        return each.select("id_a", "id_b", at, f"w{side}", F.posexplode(words).alias("block", "word"))

    met = windows("a", "i").join(windows("b", "j"), ["id_a", "id_b", "block", "word"])
    for b in range(blocks - 1):
        met = met.where((F.col("block") <= b) | (part("wa", b) != part("wb", b)))
    same = sum((F.substr("wa", F.lit(k), F.lit(1)) == F.substr("wb", F.lit(k), F.lit(1))).cast("int") for k in range(1, window + 1))
    return met.select("id_a", "id_b", "i", "j", same.alias("matches")).where(F.col("matches") >= least)
