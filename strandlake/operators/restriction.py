"""Restriction sites, digestion and its summaries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import refdata
from strandlake.functions.sizes import SMALL_ROWS
from strandlake.functions.tables import local_table
from strandlake.operators import chunks

#: A site's leading letters are written out as words while its ambiguous bases stand for this many at most.
MAX_WORDS = 64
#: Letters that a place and a site are joined on.
KEY = 4


def site_words(site: str) -> list[str]:
    """All words of the site's longest beginning that stands for MAX_WORDS words at most."""
    n = 1
    for k, c in enumerate(site):
        n *= len(refdata.AMBIGUOUS.get(c, c))
        if n > MAX_WORDS:
            site = site[:k]
            break
    return ["".join(p) for p in product(*(refdata.AMBIGUOUS.get(c, c) for c in site))]


def restriction_sites(seqs: DataFrame, enzymes: DataFrame) -> DataFrame:
    """(seq_id, name, site, cut, group, pos): all matches, also overlapping, on the given strand, of each
    row of enzymes (a dictionary; rows of one name and several sites count each).

    The letters at every place are joined with the sites on the first few of them, then compared with
    the site's words; only of sites with many ambiguous bases the rest is matched as a pattern. Sequences
    are cut into chunks, so the work is linear in their length and only hits leave a chunk.
    """
    rows = [r for r in enzymes.select("name", "site", "cut", "group").collect() if r.site]
    if not rows:
        return seqs.select("seq_id").limit(0).join(enzymes.select("name", "site", "cut", "group"), F.lit(True)).withColumn("pos", F.lit(0))
    longest, key = max(len(r.site) for r in rows), min([KEY, *(len(site_words(r.site)[0]) for r in rows)])
    words = [(w[:key], w, len(w) == len(r.site), *r) for r in rows for w in site_words(r.site)]
    sites = local_table(seqs.sparkSession, words, "key string, begin string, whole boolean, name string, site string, cut int, group string")
    places = chunks.positioned_words(seqs, longest, "#").withColumn("key", F.left("word", F.lit(key)))
    met = places.join(F.broadcast(sites) if len(words) <= SMALL_ROWS else sites, "key").where(F.startswith("word", "begin"))
    rest = F.lit(False)
    for site in {r.site for r in rows if len(site_words(r.site)[0]) < len(r.site)}:
        rest = F.when(F.col("site") == site, F.col("word").rlike(f"^{refdata.as_class(site)}")).otherwise(rest)
    return met.where(F.col("whole") | rest).select("seq_id", "name", "site", "cut", "group", "pos")


def cuts(sites: DataFrame) -> DataFrame:
    """(seq_id, name, cut_at): where each site is cut."""
    return sites.select("seq_id", "name", (F.col("pos") + F.least("cut", F.length("site"))).alias("cut_at"))


def digest(seqs: DataFrame, sites: DataFrame) -> DataFrame:
    """(seq_id, start, end, size, fragment) of each sequence cut at all its sites, as a linear molecule."""
    ends = seqs.select("seq_id", F.explode(F.array(F.lit(0), F.length("sequence"))).alias("at"))
    every = ends.union(cuts(sites).select("seq_id", F.col("cut_at").alias("at"))).distinct()
    after = F.lead("at").over(Window.partitionBy("seq_id").orderBy("at"))
    pieces = every.withColumn("end", after).where("end > at").select("seq_id", F.col("at").alias("start"), "end", (F.col("end") - F.col("at")).alias("size"))
    return chunks.cut_out(seqs, pieces, "fragment")


def digest_summary(sites: DataFrame, n_enzymes: int) -> DataFrame:
    """Cutters, those of one site, all cuts and non-cutters of each sequence that is cut at all."""
    per = sites.groupBy("seq_id", "name").agg(F.count("*").alias("n"))
    return per.groupBy("seq_id").agg(F.count("*").alias("cutters"), F.count_if(F.col("n") == 1).alias("unique_cutters"), F.sum("n").alias("cuts")).withColumn("non_cutters", F.lit(n_enzymes) - F.col("cutters"))


def filter_enzymes(sites: DataFrame, group: str | None = None, cut_class: str | None = None) -> DataFrame:
    """(seq_id, name, group, n) of enzymes of a group and a class of cuts: 1, 2-3 or 4+."""
    per = sites.groupBy("seq_id", "name", "group").agg(F.count("*").alias("n"))
    per = per.where(F.col("group") == group) if group else per
    test = {"1": F.col("n") == 1, "2-3": F.col("n").between(2, 3), "4+": F.col("n") >= 4}
    return per.where(test[cut_class]) if cut_class else per


def fragment_shares(fragments: DataFrame) -> DataFrame:
    """fragments plus share (percent of the cut sequence's length) and the number of fragments."""
    own = Window.partitionBy("seq_id")
    return fragments.withColumns({"share": 100.0 * F.col("size") / (F.max("end").over(own) - F.greatest(F.min("start").over(own), F.lit(0))), "fragments": F.count("*").over(own)})


def gel_migration(fragments: DataFrame) -> DataFrame:
    """(seq_id, kind, size, migration) of fragments and of the ladder's sizes in range."""
    own = fragments.groupBy("seq_id").agg(F.max("end").alias("longest"), F.greatest(F.least(F.min("size"), F.lit(50)), F.lit(10)).alias("least"))
    top, bottom = F.log10("longest"), F.log10("least")

    def migration(size: Column) -> Column:
        return (top - F.log10(F.greatest(size, F.lit(1)))) / F.greatest(top - bottom, F.lit(1.0))

    bands = fragments.join(own, "seq_id").select("seq_id", F.lit("fragment").alias("kind"), F.col("size").cast("long").alias("size"), migration(F.col("size")).alias("migration"))
    ladder = own.select("seq_id", "longest", "least", F.explode(F.array(*[F.lit(x) for x in refdata.LADDER])).alias("size")).where((F.col("size") <= 2 * F.col("longest")) & (F.col("size") >= 0.5 * F.col("least")))
    return bands.union(ladder.select("seq_id", F.lit("ladder"), F.col("size").cast("long"), migration(F.col("size"))))


def cut_map(sites: DataFrame, max_marks: int = 50) -> DataFrame:
    """Cuts in order of place and enzyme, thinned evenly to at most max_marks a sequence."""
    own = Window.partitionBy("seq_id")
    ranked = sites.select("seq_id", "name", "pos").withColumns({"k": F.row_number().over(own.orderBy("pos", "name")) - 1, "n": F.count("*").over(own)})
    step = F.when(F.col("n") > max_marks, F.ceil(F.col("n") / max_marks)).otherwise(1)
    return ranked.where(F.col("k") % step == 0).select("seq_id", "name", "pos")
