"""Motif search: leftmost matches that do not overlap, on one or both strands."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.functions import refdata
from strandlake.functions.sizes import broadcast_if_small
from strandlake.functions.tables import local_table
from strandlake.operators import chunks


def pattern_of(motif: str, mode: str = "exact") -> str:
    """The regular expression of a motif: exact letters, ambiguous bases (iupac) or a regex.

    Letters are upper-cased, but not those of an escape; a pattern that matches nothing at all is refused.
    """
    if mode == "exact":
        out = re.escape(motif.upper())
    elif mode == "iupac":
        out = refdata.as_class(re.escape(motif.upper()))
    else:
        out = re.sub(r"\\.|[a-z]+", lambda m: m[0] if m[0][0] == "\\" else m[0].upper(), motif)
    if re.compile(out).match("") is not None:
        raise ValueError(f"pattern {motif!r} matches the empty string")
    return out


#: Letters of a motif that it is found by, of what its places are compared with at once, and how many words ambiguous
#: bases may be written out as. None changes a result.
KEY, BEGIN, MAX_WORDS = 8, 16, 64
#: Words up to which a place is asked for each of them before its letters are joined with them. Never changes a result.
ASKED_WORDS = 64
#: Which letters are read as a base on the opposite strand.
READ_AS = {"A": "TU", "T": "A", "C": "G", "G": "C", "U": ""}
_WAYS = "array<struct<strand:string,size:int,keys:array<string>,begin:string,whole:string>>"


def _pattern(sets: list[str]) -> str:
    return "".join(re.escape(s) if len(s) == 1 else f"[{s}]" for s in sets)


def _ways(motif: str, mode: str) -> list[tuple] | None:
    """(strand, size, keys, begin, whole) of a motif of fixed length, as it stands on the given strand; None for a regex. keys
    are all words of its first letters, begin and whole patterns of the first BEGIN and of all its letters."""
    if mode == "regex":
        return None
    plus = [refdata.AMBIGUOUS.get(c, c) if mode == "iupac" else c for c in motif.upper()]
    minus = ["".join(READ_AS.get(c, c) for c in s) for s in reversed(plus)]
    out = []
    for strand, sets in (("+", plus), ("-", minus)):
        n = size = 1
        while size < min(KEY, len(sets)) and n * len(sets[0]) * len(sets[size]) <= MAX_WORDS:
            n, size = n * len(sets[size]), size + 1
        if all(sets):
            out.append((strand, len(sets), ["".join(p) for p in product(*sets[:size])], f"^{_pattern(sets[:BEGIN])}", _pattern(sets)))
    return out


def motif_table(spark, motifs: list[tuple[str, str]], mode: str = "exact") -> DataFrame:
    """(motif, pattern, ways) from (name, motif) pairs; ways are null for regexes."""
    return local_table(spark, [(name, pattern_of(m, mode), _ways(m, mode)) for name, m in motifs], f"motif string, pattern string, ways {_WAYS}")


def find_motifs(seqs: DataFrame, motifs: DataFrame, both_strands: bool = True) -> DataFrame:
    """(seq_id, motif, strand, pos, match): hits of every motif of a motif_table; those on the opposite strand are placed on
    the given one, with the match as read there. A column type, if any, keeps proteins to one strand.

    Motifs of fixed length, however many, are found together, in chunks; regexes one by one in whole sequences."""
    fixed = _find_fixed(seqs, motifs.where("ways is not null"), both_strands)
    return fixed.unionByName(_find_regexes(seqs, motifs.where("ways is null"), both_strands))


def _find_fixed(seqs: DataFrame, motifs: DataFrame, both_strands: bool) -> DataFrame:
    """Letters at every place are joined with the motifs' first ones, so sequences and motifs make no product; hits are
    compared with the rest, and of each motif those stay that begin behind the one before."""
    ways = motifs.select("motif", F.inline("ways"))
    if not both_strands:
        ways = ways.where("strand = '+'")
    words = ways.select("motif", "strand", "size", "begin", "whole", F.explode("keys").alias("key"))
    sizes = [r.n for r in words.select(F.length("key").alias("n")).distinct().collect()]  # KEY at most
    width = min(BEGIN, words.agg(F.max("size")).first()[0] or 1)  # letters of a place that any motif needs
    asked = [r.key for r in words.select("key").distinct().limit(ASKED_WORDS + 1).collect()]
    keys = F.array(*[F.left("word", F.lit(n)) for n in sizes]) if sizes else F.array().cast("array<string>")
    places = chunks.positioned_words(seqs, width, "\0")
    if 0 < len(asked) <= ASKED_WORDS:
        places = places.where(reduce(lambda a, b: a | b, [F.col("word").startswith(k) for k in asked]))
    places = places.select("seq_id", "pos", "word", F.explode(keys).alias("key"))
    met = places.join(broadcast_if_small(words), "key").where(F.expr("word rlike begin"))
    if "type" in seqs.columns:
        met = met.join(seqs.where("type = 'protein'").select("seq_id", F.lit("-").alias("strand")), ["seq_id", "strand"], "left_anti")
    columns = ["seq_id", "motif", "strand", "pos", "size"]
    short = met.where(F.col("size") <= BEGIN).select(*columns, F.expr("left(word, size)").alias("text"))
    spans = met.where(F.col("size") > BEGIN).select(*columns, "whole", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end"))
    long = chunks.cut_out(seqs, spans, "text").where((F.length("text") == F.col("size")) & F.expr("text rlike concat('^', whole, '$')")).select(*columns, "text")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of hits in the order in which their strand is read those that do not overlap the one taken before. One that is
        as far behind the hit before it as any hit is long is taken at once; only the others are gone through."""
        last, end, widest = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, size = (batch.column(c).to_numpy().astype(np.int64) for c in ("pos", "size"))
            plus = pc.equal(batch.column("strand"), "+").to_numpy(zero_copy_only=False)
            at, widest = np.where(plus, pos, -pos - size), max(widest, int(size.max()))
            clear = np.ones(len(at), bool)
            clear[1:] = np.diff(at) >= widest
            for c in columns[:3]:
                clear[1:] |= np.diff(batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0
            key = lambda k: tuple(batch.column(c)[k].as_py() for c in columns[:3])  # noqa: B023, E731
            clear[0] = key(0) != last
            for k in np.flatnonzero(~clear).tolist():
                if k and clear[k - 1]:
                    end = at[k - 1] + size[k - 1]
                if at[k] >= end:
                    clear[k], end = True, at[k] + size[k]
            own = np.flatnonzero(clear)
            last, end = key(len(at) - 1), int(at[own[-1]] + size[own[-1]]) if len(own) else end
            yield batch.take(pa.array(own))

    every = short.unionByName(long)
    order = F.when(F.col("strand") == "+", F.col("pos")).otherwise(-F.col("pos") - F.col("size"))
    ordered = every.repartition("seq_id", "motif", "strand").sortWithinPartitions("seq_id", "motif", "strand", order)
    taken = ordered.mapInArrow(apart, every.schema)
    return taken.select("seq_id", "motif", "strand", "pos", F.when(F.col("strand") == "+", F.col("text")).otherwise(C.reverse_complement(F.col("text"))).alias("match"))


def _find_regexes(seqs: DataFrame, motifs: DataFrame, both_strands: bool) -> DataFrame:
    s = F.upper("sequence")
    nucleic = F.col("type") != "protein" if "type" in seqs.columns else F.lit(True)
    strands = F.array(F.struct(F.lit("+").alias("strand"), s.alias("s")), *([F.struct(F.lit("-").alias("strand"), F.when(nucleic, C.reverse_complement(s)).alias("s"))] if both_strands else []))
    rows = seqs.select("seq_id", F.inline(strands)).crossJoin(broadcast_if_small(motifs)).where(F.expr("s rlike pattern"))
    found = rows.select("seq_id", "motif", "strand", F.length("s").alias("n"), F.regexp_extract_all("s", F.col("pattern"), F.lit(0)).alias("m"), F.transform(F.expr("split(s, pattern, -1)"), F.length).alias("gaps"))
    each = found.select("seq_id", "motif", "strand", "n", "gaps", F.posexplode("m").alias("k", "match"))
    so_far = Window.partitionBy("seq_id", "motif", "strand").orderBy("k")
    end = F.sum(F.get("gaps", F.col("k")) + F.length("match")).over(so_far)
    placed = each.withColumn("end", end)
    pos = F.when(F.col("strand") == "+", F.col("end") - F.length("match")).otherwise(F.col("n") - F.col("end"))
    return placed.select("seq_id", "motif", "strand", pos.cast("int").alias("pos"), "match")


def motif_context(hits: DataFrame, seqs: DataFrame, flank: int = 10) -> DataFrame:
    """hits plus before and after: up to flank bases of the given strand on either side."""
    own = hits.join(seqs.select("seq_id", F.upper("sequence").alias("_s")), "seq_id")
    before = F.substr("_s", F.greatest(F.lit(1), F.col("pos") + 1 - flank), F.least(F.lit(flank), F.col("pos")))
    after = F.substr("_s", F.col("pos") + F.length("match") + 1, F.lit(flank))
    return own.withColumns({"before": before, "after": after}).drop("_s")


def motif_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("seq_id", "motif").agg(F.count("*").alias("total"), F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))


def motif_density(hits: DataFrame, seqs: DataFrame, bins: int = 10) -> DataFrame:
    """(motif, bin, count) by relative position in the sequence."""
    own = hits.join(seqs.select("seq_id", F.length("sequence").alias("_n")), "seq_id")
    return own.groupBy("motif", F.floor(F.col("pos") * bins / F.col("_n")).cast("int").alias("bin")).agg(F.count("*").alias("count"))
