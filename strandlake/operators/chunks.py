"""Long sequences in chunks: pieces with a halo, words at every place, and the text of spans.

A sequence is cut in one pass over its text, so the work is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a chunk. Never changes a result.
CHUNK = 4096


def with_halo(seqs: DataFrame, size: int = CHUNK, halo: int = 0) -> DataFrame:
    """(seq_id, chunk, start, core, sequence): pieces of size letters plus the next halo ones; core is the
    number of letters that are the piece's own. Empty and null sequences have none. seqs that are pieces of size letters
    (seq_id, chunk, start, sequence) already, as chunked readers give them, get the halo by a join with the next ones."""
    if "chunk" in seqs.columns:
        own = seqs.select("seq_id", "chunk", "start", F.length("sequence").alias("core"), "sequence")
        for k in range(1, -(-halo // size) + 1):
            head = seqs.select("seq_id", (F.col("chunk") - k).alias("chunk"), F.left("sequence", F.lit(halo - (k - 1) * size)).alias("_next"))
            own = own.join(head, ["seq_id", "chunk"], "left").withColumn("sequence", F.concat("sequence", F.coalesce("_next", F.lit("")))).drop("_next")
        return own
    pieces = seqs.select("seq_id", F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("pieces"))
    each = pieces.select("seq_id", "pieces", F.posexplode("pieces").alias("chunk", "own"))
    following = F.slice("pieces", F.col("chunk") + 2, F.lit(max(1, -(-halo // size))))
    more = F.left(F.array_join(following, ""), F.lit(halo)) if halo else F.lit("")
    return each.select("seq_id", "chunk", (F.col("chunk") * size).alias("start"), F.length("own").alias("core"), F.concat("own", more).alias("sequence"))


#: Places whose words are taken from one short piece of the text. Never changes a result.
PIECE = 64


def words_at(text: Column, k: int) -> Column:
    """Array of the k letters from every place of the text that has so many. Taking letters out of a text costs its
    length up to them, so they are taken out of short pieces of it."""
    places = lambda n, step=1: F.when(n >= k, F.sequence(F.lit(1), n - (k - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))
    words = lambda piece: F.transform(places(F.length(piece)), lambda at: F.substr(piece, at, F.lit(k)))
    pieces = lambda s: F.transform(places(F.length(s), PIECE), lambda at: F.substr(s, at, F.lit(PIECE + k - 1)))
    # text may be a long expression: as an element it is made once, not anew for each piece
    return F.flatten(F.get(F.transform(F.array(text), lambda s: F.transform(pieces(s), words)), F.lit(0)))


def positioned_words(seqs: DataFrame, k: int, pad: str | None = None) -> DataFrame:
    """(seq_id, pos, word): the k letters of the upper-cased sequence from every place on; with a pad (one
    character) also from the last k - 1 places, filled up."""
    own = with_halo(seqs.withColumn("sequence", F.upper("sequence")), CHUNK, k - 1)
    text = F.rpad("sequence", F.col("core") + (k - 1), F.lit(pad)) if pad else F.col("sequence")
    return own.select("seq_id", "start", F.posexplode(words_at(text, k)).alias("at", "word")).select("seq_id", (F.col("start") + F.col("at")).cast("int").alias("pos"), "word")


def cut_out(seqs: DataFrame, spans: DataFrame, name: str = "part") -> DataFrame:
    """spans (seq_id, start, end, ...; no two rows equal) plus the upper-cased letters from start (0 if
    before it) up to end. Spans meet the chunks that they overlap, so a sequence is read once however many
    spans it has."""
    others = [c for c in spans.columns if c != "seq_id"]
    lo, hi = F.greatest(F.col("start"), F.lit(0)), F.greatest(F.col("end"), F.lit(0))
    covered = F.when(hi > lo, F.sequence(F.floor(lo / CHUNK).cast("int"), F.floor((hi - 1) / CHUNK).cast("int"))).otherwise(F.array(F.lit(0)))
    each = spans.select("*", F.explode(covered).alias("chunk"))
    own = with_halo(seqs.withColumn("sequence", F.upper("sequence")), CHUNK).select("seq_id", "chunk", F.col("start").alias("_at"), "sequence")
    first = F.greatest(lo - F.col("_at"), F.lit(0))
    piece = F.substr("sequence", (first + 1).cast("int"), F.greatest(hi - F.col("_at") - first, F.lit(0)).cast("int"))
    met = each.join(own, ["seq_id", "chunk"]).select("seq_id", *others, "chunk", piece.alias("piece"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "piece"))), lambda p: p["piece"]), "")
    return met.groupBy("seq_id", *others).agg(parts.alias(name))
