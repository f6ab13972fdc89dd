"""Odd sequence files, in batches and in a stream."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake import plans
from strandlake.operators import windows
from strandlake.sources import sequences, structures
from strandlake.streaming.sequences import annotate_stream, stream_sequences

FASTA = "junk line\nACGT\n>a one two\nACGT\n\n  AC GT  \n  >b\tfour \nGG>GG\n>\nTTTT\n> spaced name\nCC\n\t> \n>last\n"


def slow_fasta(text):
    out, name, told, letters = [], "", "", ""
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith(">"):
            if name:
                out.append((name, told, letters))
            parts = line[1:].split(None) if line[1:2].strip() else ["", *line[1:].split()]
            name, told, letters = (parts[0] if parts else "") or "Unnamed", " ".join(parts[1:]), ""
        else:
            letters += "".join(line.split())
    return [*out, (name, told, letters)] if name else out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("text", [FASTA, FASTA[FASTA.index(">") :], "no header\nACGT\n", "", "\n\n >x\nAC", ">x"])
def test_fasta_is_read_line_by_line(spark, tmp_path, text, end):
    (tmp_path / "x.fasta").write_bytes(text.replace("\n", end).encode())
    got = sorted((r.name, r.description, r.sequence) for r in sequences.read_fasta(spark, f"{tmp_path}/x.fasta").collect())
    assert got == sorted(slow_fasta(text))


def test_files_over_several_splits(spark, tmp_path):
    text = "before\nACGT\n" + "".join(f"{' ' * (i % 3)}>r{i} d\n{'ACGT' * 20}\n" for i in range(3000))
    for k in range(3):
        (tmp_path / f"{k}.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    found = sequences.read_fasta(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 20
    assert found.groupBy("sequence").count().collect() == [("ACGT" * 20, 9000)] and found.select("name").distinct().count() == 3000
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("split, size", [(1 << 20, 4096), (3000, 700), (400, 64)])
def test_records_over_many_splits_in_chunks(spark, tmp_path, split, size):
    """A record is read in pieces of file ranges, with the same letters and names as a whole one."""
    rng = random.Random(split)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    lines = lambda s: "".join(f"{s[k : k + 60]}\n" for k in range(0, len(s), 60))
    long = letters(20_001)
    texts = ["before\nACGT\n>a one\n" + lines(long) + ">b\n>c two three\n" + lines(letters(61)) + "  >d\n AC GT \r\n", FASTA, ">only\n" + lines(letters(5000)), "", "no header\n"]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.fa").write_text(t, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        records, chunks = sequences.read_fasta_chunks(spark, str(tmp_path), size)
        named = {r.seq_id: (r.name, r.description, r.length) for r in records.collect()}
        found = chunks.orderBy("seq_id", "chunk").collect()
        own = windows.window_gc(chunks, 50).count() if size == 4096 else None
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = {k: "" for k in named}
    for r in found:
        assert r.start == len(text[r.seq_id]) == r.chunk * size and 0 < len(r.sequence) <= size
        text[r.seq_id] += r.sequence
    want = [x for t in texts for x in slow_fasta(t)]
    assert sorted((*named[k][:2], text[k]) for k in named) == sorted(want) and all(named[k][2] == len(text[k]) for k in named)
    assert own is None or own == sum(max(0, len(x[2]) - 49) for x in want)


GENBANK = 'LOCUS       NC1 30 bp\nDEFINITION  made\nFEATURES             Location/Qualifiers\n     gene            3..9\n                     /gene="g"\nORIGIN\n        1 taatacgact cactataggg acgt\n//\n'


def test_qualifiers_that_repeat_or_go_on(spark, tmp_path):
    told = '/db_xref="GI:1"', "/pseudo", "/codon_start=1", '/note="one', 'two /gene=no"', '/db_xref="GeneID:2"', '/db_xref="X:3"'
    text = "DEFINITION  made\nFEATURES             Location/Qualifiers\n" + "".join(f"     CDS             {k}..9\n" + "".join(f"                     {t}\n" for t in told) for k in (1, 3)) + "ORIGIN\n        1 acgt*\n//\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.gb").write_text(text)
    row = sequences.read_genbank(spark, f"{tmp_path}/in").first()
    want = {"db_xref": "X:3", "codon_start": "1", "note": "one"}
    assert (row.name, row.sequence) == ("Unknown", "ACGT*") and [f.qualifiers for f in row.features] == [want, want]
    annotate_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/sequences").first().features[1].qualifiers == want


def test_all_kinds_in_batches_and_in_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fasta").write_text("x\n>f one\nTAATACGACTCACTATAGGGAC\n  >g\nACGU\n")
    (folder / "b.GB").write_text(GENBANK)
    (folder / "c.txt").write_text("ACGT\nAC GT\n")
    want = [("NC1", "genbank", "TAATACGACTCACTATAGGGACGT"), ("c.txt", "raw", "ACGTACGT"), ("f", "fasta", "TAATACGACTCACTATAGGGAC"), ("g", "fasta", "ACGU")]
    records, features = sequences.import_sequences(spark, [f"{folder}/a.fasta", f"{folder}/b.GB", f"{folder}/c.txt"])
    assert sorted((r.name, r.format, r.sequence) for r in records.collect()) == want
    assert sorted((r.name, r.source, r.start, r.end) for r in features.collect()) == [("T7 promoter", "auto", 0, 20)] * 2 + [("g", "file", 2, 9)]
    assert set(stream_sequences(spark, str(folder)).columns) >= {"name", "sequence", "seq_id", "features"}
    annotate_stream(spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/sequences")
    assert sorted((r.name, r.format, r.sequence) for r in got.collect()) == want
    assert spark.read.parquet(f"{tmp_path}/out/features").where(F.col("name") == "T7 promoter").count() == 2


@pytest.mark.parametrize("numbers", [[0, 9999, 10_000, 10_035, 99_999, 1_223_055, 1_223_056, 2_436_111]])
def test_numbers_wider_than_their_columns(spark, numbers):
    rows = spark.createDataFrame([(n,) for n in numbers], "n int")
    text = rows.select("n", structures.to_hybrid_36(F.col("n"), 4).alias("v"), structures.to_hybrid_36(F.col("n"), 5).alias("w"))
    told = {r.n: r.v for r in text.collect()}
    assert told[9999] == "9999" and told[10_000] == "A000" and told[1_223_055] == "ZZZZ" and told[1_223_056] == "a000" and told[2_436_111] == "zzzz"
    back = text.select("n", structures.from_hybrid_36(F.trim("v"), 4).alias("v"), structures.from_hybrid_36(F.trim("w"), 5).alias("w"))
    assert all(r.n == r.v == r.w for r in back.collect())
    with pytest.raises(Exception, match="no place in 4 columns for 2436112"):
        spark.range(1).select(structures.to_hybrid_36(F.col("id") + 2_436_112, 4)).collect()
    odd = spark.createDataFrame([("A0",), ("aB00",), ("",), ("-3",)], "v string").select("v", structures.from_hybrid_36(F.col("v"), 4).alias("n"))
    assert {r.v: r.n for r in odd.collect()} == {"A0": None, "aB00": None, "": None, "-3": -3}


def test_structures_of_more_residues_than_columns_hold(spark, tmp_path):
    rows = spark.createDataFrame([(k, [0.01, 0.02, 0.03], 0) for k in (1, 9999, 10_001, 100_011)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, column in (("io_13_read_structures", "resi"), ("st_2_residues", "resi")):
        found = plans.QUERIES[name](spark, str(tmp_path)).select(column).distinct().collect()
        assert sorted(r[0] for r in found) == [1, 9999, 10_001, 100_011]
    assert plans.QUERIES["st_1_structure_summary"](spark, str(tmp_path)).first().residues == 4


def test_streamed_records_keep_the_planted_feature(spark, tmp_path):
    """A tag that the letters behind the planted one make by chance is found, but is not the planted one."""
    text = {0: "A" * 20 + "CATCAC" + "A" * 9, 6: "A" * 14 + "CATCAC" + "A" * 9, 4: "ACGT", 3: "A" * 14 + "GTGATG" + "A" * 5}
    spark.createDataFrame([(k, v) for k, v in text.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, plans.QUERIES["io_5_stream_sequences"](spark, str(tmp_path)).collect()))
    assert found == [("p0", "6xHis tag", 20, 38, "+"), ("p3", "6xHis tag", 20, 38, "-"), ("p4", "T7 promoter", 4, 24, "+"), ("p6", "6xHis tag", 20, 38, "+")]
