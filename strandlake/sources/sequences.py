"""FASTA, GenBank and raw text as DataFrames, header parsing, writing and printing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.functions import refdata
from strandlake.functions.sizes import broadcast_if_small
from strandlake.operators.annotate import auto_annotate
from strandlake.operators.chunks import CHUNK

GENBANK, FASTA = (".gb", ".gbk", ".genbank"), (".fasta", ".fa", ".fna", ".faa", ".seq")
_FEATURE = r"^ {5}(\S+)\s+(complement\()?(\d+)\.\.(\d+)\)?"
#: A qualifier's name and the first line of its value, with or without quotes.
_QUALIFIER = r'\n[ \t]+/(\w+)="?([^"\n]*)'


# Fixed value: white space around a header's mark, but no line end.
_BLANK = r"[\s\x{A0}\x{FEFF}&&[^\n]]*"


def parse_fasta(records: DataFrame, *keep: str) -> DataFrame:
    """(name, description, type, sequence, format) of rows (value): one record's lines, with or without its mark; and
    the columns keep.

    A header that is empty or starts with white space names nothing: the record is Unnamed."""
    lines = F.split(F.regexp_replace(F.col("value"), f"^{_BLANK}>", ""), "\n")
    header = F.regexp_replace(F.get(lines, 0), r"\s+$", "")
    words = F.split(header, r"\s+")
    sequence = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "")
    blank = (header == "") | header.rlike(r"^\s")
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return records.select(*keep, F.when(blank, "Unnamed").otherwise(F.get(words, 0)).alias("name"), rest.alias("description"), C.detect_type(sequence).alias("type"), sequence.alias("sequence"), F.lit("fasta").alias("format"))


def fasta_records(rows: DataFrame) -> DataFrame:
    """(value), a record each, of text rows cut at a line end and mark (lineSep="\\n>").

    Only in the first row of a file the mark may be missing: what stands there before the first header is no
    record. The reader meets a file's rows in order, so that row is the first one of the file's first block.
    Rows are then cut again at marks with white space before them."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            firsts = []
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                firsts.append((path, block) != last and block == 0)
                last = path, block
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(firsts, pa.bool_())], names=["value", "first"])

    own = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    marked = own.mapInArrow(mark, "value string, first boolean")
    text = F.concat(F.when(F.col("first"), "\n").otherwise("\n>"), "value")
    parts = F.split(text, f"\n{_BLANK}>")
    return marked.select(F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row a record. A record starts at a line whose first letter is the mark >, white space aside; text before
    the first one is left out. Large files are split at marks that start a line."""
    return parse_fasta(fasta_records(spark.read.text(path, lineSep="\n>")))


#: Fixed value: what starts a record's header line.
_MARK = re.compile(r"[\s\xa0\ufeff]*>")


def _pieces(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, block, record, start, header, letters) of FASTA files, each block (a file range that one reader takes) by
    itself: a row for every header, and pieces of at most size letters. record counts the block's headers; what stands
    before the first one (record 0) goes on from the blocks before, and start counts from the block's beginning there."""
    names, schema = ["path", "block", "record", "start", "header", "letters"], "path string, block long, record long, start long, header string, letters string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, record, start, held, n, out = None, 0, 0, [], 0, []

        def flush(least: int) -> None:
            nonlocal start, held, n
            text = "".join(held)
            while len(text) >= max(least, 1):
                out.append((*where, record, start, None, text[:size]))
                start, text = start + len(text[:size]), text[size:]
            held, n = [text] if text else [], len(text)

        for batch in batches:
            for line, *place in zip(*(batch.column(c).to_pylist() for c in ("value", "path", "block")), strict=True):
                if place != where:
                    if where:
                        flush(1)
                    where, record, start, held, n = place, 0, 0, [], 0
                if _MARK.match(line):
                    flush(1)
                    record, start, held, n = record + 1, 0, [], 0
                    out.append((*where, record, 0, line, ""))
                    continue
                held.append("".join(line.split()))
                n += len(held[-1])
                if n >= size:
                    flush(size)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=names)
                out.clear()
        if where:
            flush(1)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=names)

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return lines.mapInArrow(cut, schema)


def read_fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(records, chunks) of FASTA files whose records may be larger than a row or a task: records (seq_id, name, description,
    length) and chunks (seq_id, chunk, start, sequence) of size letters, the last one of a record shorter.

    File ranges are cut into pieces apart from each other; only how many letters each range has before its first header
    and behind its last one is added up along a file. Operators that cut sequences into chunks take the chunks as they are."""
    pieces = _pieces(spark, path, size)
    length = F.length("letters")
    blocks = pieces.groupBy("path", "block").agg(F.max("record").alias("headers"), F.sum(F.when(F.col("record") == 0, length).otherwise(0)).alias("lead"), F.max_by(F.col("start") + length, F.struct("record", "start", length)).alias("tail"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    led = blocks.withColumn("led", F.coalesce(F.sum("lead").over(before), F.lit(0)))
    begun = F.last(F.when(F.col("headers") > 0, F.struct(F.col("block").alias("block"), F.col("headers").alias("record"), (F.col("tail") - F.col("led") - F.col("lead")).alias("base"))), ignorenulls=True).over(before)
    carried = led.withColumn("begun", begun).select("path", "block", "begun.record", (F.col("begun.base") + F.col("led")).alias("base"), F.col("begun.block").alias("of"))
    carried = broadcast_if_small(carried.toDF("path", "block", "_record", "_base", "_of"))
    placed = pieces.join(carried, ["path", "block"])
    first = F.col("record") == 0  # of a file's first block this is text before any header, which is no record
    seq_id = F.xxhash64("path", F.when(first, F.col("_of")).otherwise(F.col("block")), F.when(first, F.col("_record")).otherwise(F.col("record")))
    own = placed.where(~first | F.col("_record").isNotNull()).select(seq_id.alias("seq_id"), (F.col("start") + F.when(first, F.col("_base")).otherwise(0)).alias("start"), "header", "letters")
    told = parse_fasta(own.where("header is not null").withColumn("value", F.col("header")), "seq_id").select("seq_id", "name", "description")
    sizes = own.groupBy("seq_id").agg(F.sum(F.length("letters")).alias("length"))
    at = lambda place: F.floor(place / size).cast("int")
    parts = own.where("letters <> ''").select("seq_id", "start", "letters", F.explode(F.sequence(at(F.col("start")), at(F.col("start") + F.length("letters") - 1))).alias("chunk"))
    lo = F.greatest(F.col("start"), F.col("chunk").cast("long") * size)
    hi = F.least(F.col("start") + F.length("letters"), (F.col("chunk").cast("long") + 1) * size)
    cut = parts.select("seq_id", "chunk", F.struct(lo.alias("at"), F.substr("letters", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("text")).alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"]), "")
    chunks = cut.groupBy("seq_id", "chunk").agg(joined.alias("sequence")).select("seq_id", "chunk", (F.col("chunk").cast("long") * size).alias("start"), "sequence")
    return told.join(sizes, "seq_id"), chunks


def parse_genbank(records: DataFrame) -> DataFrame:
    """(name, description, type, sequence, features, format) of rows (value): one record's text.

    A feature's qualifiers are a map; values that go on over several lines give their first one."""
    text = F.regexp_replace("value", r"\r", "")
    origin = F.regexp_extract(text, r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    sequence = F.upper(F.regexp_replace(origin, r"[\s\d/]", ""))
    table = F.regexp_extract(text, r"(?s)\nFEATURES[^\n]*\n(.*?)(?:\nORIGIN|$)", 1)
    # a block is a key's line and the lines of its qualifiers; blocks of other locations are skipped whole
    blocks = F.filter(F.split(table, r"\n(?= {5}\S)|^(?= {5}\S)"), lambda b: b.rlike(_FEATURE))
    keys, told = (lambda b, k=k: F.regexp_extract_all(b, F.lit(_QUALIFIER), F.lit(k)) for k in (1, 2))
    # of a qualifier that a feature has twice or more the last one counts
    last = lambda b: F.filter(F.arrays_zip(keys(b).alias("key"), told(b).alias("value")), lambda x, k: ~F.array_contains(F.slice(keys(b), k + 2, F.size(keys(b))), x["key"]))
    pairs = lambda b: F.map_from_entries(last(b))
    feature = lambda b: F.struct(
        F.regexp_extract(b, _FEATURE, 1).alias("type"), (F.regexp_extract(b, _FEATURE, 3).cast("int") - 1).alias("start"), F.regexp_extract(b, _FEATURE, 4).cast("int").alias("end"),
        F.when(F.regexp_extract(b, _FEATURE, 2) != "", "-").otherwise("+").alias("strand"), pairs(b).alias("qualifiers"),
    )
    found = records.select(
        F.coalesce(F.nullif(F.regexp_extract(text, r"(?:^|\n)LOCUS[ \t]+(\S+)", 1), F.lit("")), F.lit("Unknown")).alias("name"), F.trim(F.regexp_extract(text, r"(?:^|\n)DEFINITION {2}([^\n]*)", 1)).alias("description"),
        C.detect_type(sequence).alias("type"), sequence.alias("sequence"), F.transform(blocks, feature).alias("features"), F.lit("genbank").alias("format"),
    )
    return found.where("sequence <> ''")


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """One row a record; records end at a // that starts a line."""
    return parse_genbank(spark.read.text(path, lineSep="\n//"))


def genbank_features(records: DataFrame) -> DataFrame:
    """(name, type, start, end, strand, qualifiers, source), a row a feature."""
    return records.select(F.col("name"), F.explode("features").alias("f")).select("name", "f.*", F.lit("file").alias("source"))


def raw_records(files: DataFrame) -> DataFrame:
    """(name, description, type, sequence, format) of rows that are whole files: the text without white space."""
    rows = files.select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", r"\s", "").alias("sequence"))
    return rows.select("name", F.lit("").alias("description"), C.detect_type(F.col("sequence")).alias("type"), "sequence", F.lit("raw").alias("format"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: the whole text without white space, named after the file."""
    return raw_records(spark.read.text(path, wholetext=True))


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files by their extension, with the UniProt id of proteins; features of GenBank files are kept."""
    kinds = {read_genbank: [p for p in paths if p.lower().endswith(GENBANK)], read_fasta: [p for p in paths if p.lower().endswith(FASTA)]}
    kinds[read_raw] = [p for p in paths if not p.lower().endswith(GENBANK + FASTA)]
    out = None
    for read, own in kinds.items():
        for p in own:
            part = read(spark, p)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return extract_uniprot_id(out)


# Formats of headers (pattern, group of the accession, group of a name if any), best first, and the
# two ways in which a header gives its organism.
HEADER_FORMATS = [
    (r"^(?:sp|tr)\|([A-Z0-9]+)\|(\S+)", 1, 2),
    (r"gi\|\d+\|(?:ref|gb|emb|dbj)\|([^|]+)\|", 1, None),
    (r"^([A-Z][A-Z0-9_]+(?:\.\d+)?)", 1, None),
]
ORGANISM_FORMATS = [r"\[([^\]]+)\]\s*$", r"OS=([^=]+?)(?:\s+OX=|\s+GN=|\s+PE=|\s*$)"]


def _named(header: Column, pattern: str, accession: int, name: int | None) -> Column:
    """(accession, name) as a struct by one format, null where the header has another one. A name loses its
    species; formats without one have none. Versions belong to accessions of formats without a name."""
    found = F.regexp_extract(header, pattern, accession)
    bare = found if name else F.regexp_replace(found, r"\.\d+$", "")
    own = F.regexp_replace(F.regexp_extract(header, pattern, name), r"_\w+$", "") if name else F.lit(None).cast("string")
    return F.when(found != "", F.struct(bare.alias("accession"), own.alias("name")))


def parse_headers(rows: DataFrame, db: str = "nucleotide") -> DataFrame:
    """rows (header, optionally sequence) plus accession, name and organism.

    Without a name of its own an entry is named by up to three words of its description, else by its accession."""
    h = F.col("header")
    known = F.coalesce(*[_named(h, *rule) for rule in HEADER_FORMATS])
    accession = F.coalesce(known["accession"], F.lit(""))
    told = F.trim(F.regexp_replace(F.regexp_replace(h, r"^\S+\s+", ""), r"\[.*\]$", ""))
    described = F.left(F.array_join(F.slice(F.split(told, r"\s+"), 1, 3), "_"), F.lit(30))
    full = lambda c: F.nullif(c, F.lit(""))
    organism = F.coalesce(*[full(F.trim(F.regexp_extract(h, p, 1))) for p in ORGANISM_FORMATS], F.lit("NCBI Import"))
    out = rows.withColumns({"accession": accession, "name": F.coalesce(full(known["name"]), full(described), full(accession), F.lit("NCBI_seq")), "organism": organism})
    if "sequence" not in rows.columns:
        return out
    rna = F.col("sequence").rlike("(?i)u") & ~F.col("sequence").rlike("(?i)t")
    return out.withColumn("type", F.lit("protein") if db == "protein" else F.when(rna, "rna").otherwise("dna"))


def extract_uniprot_id(seqs: DataFrame) -> DataFrame:
    """seqs plus uniprot_id: of proteins, the first accession in the name, else in the description."""
    first = lambda c: F.nullif(F.regexp_extract(c, r"(?i)([A-NR-Z][0-9][A-Z0-9]{3}[0-9]|[OPQ][0-9][A-Z0-9]{3}[0-9])", 1), F.lit(""))
    return seqs.withColumn("uniprot_id", F.when(F.col("type") == "protein", F.coalesce(first(F.col("name")), first(F.col("description")))))


def accession_database(accession: Column, default: str = "nucleotide") -> Column:
    q = F.upper(accession)
    return F.when(q.rlike(r"^(NP_|XP_|WP_|YP_|AP_)|^[A-Z][0-9][A-Z0-9]{3}[0-9]|^[A-Z]{3}\d{5}"), "protein").when(q.rlike(r"^(NM_|XM_|NR_|XR_|NG_|NC_)"), "nucleotide").otherwise(default)


_REPORT = """BlastOutput2 array<struct<report:struct<results:struct<search:struct<query_len:int,hits:array<struct<
    description:array<struct<accession:string,title:string>>,hsps:array<struct<bit_score:double,evalue:double,identity:int,align_len:int,query_from:int,query_to:int>>>>>>>>>"""


def read_search_hits(reports: DataFrame, top: int = 20) -> DataFrame:
    """First segment of the first top hits of rows (report_id, json): scores, identity and coverage percent."""
    search = F.from_json("json", _REPORT)["BlastOutput2"][0]["report"]["results"]["search"]
    rows = reports.select("report_id", search.alias("s")).select("report_id", F.col("s.query_len").alias("n"), F.posexplode("s.hits").alias("rank", "h")).where(F.col("rank") < top)
    one = rows.where(F.size("h.hsps") > 0).select("report_id", "rank", "n", F.col("h.description")[0].alias("d"), F.col("h.hsps")[0].alias("p"))
    return one.select(
        "report_id", "rank", "d.accession", "d.title", "p.bit_score", "p.evalue", (100.0 * F.col("p.identity") / F.col("p.align_len")).alias("identity"),
        (100.0 * (F.col("p.query_to") - F.col("p.query_from") + 1) / F.when(F.col("n") > 0, F.col("n")).otherwise(1)).alias("coverage"),
    )


def fasta_text(seqs: DataFrame, width: int = 70) -> DataFrame:
    """(seq_id, value): >name and description, then lines of width letters."""
    header = F.concat(F.lit(">"), "name", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise("")) if "description" in seqs.columns else F.concat(F.lit(">"), "name")
    return seqs.select("seq_id", F.concat(header, F.lit("\n"), F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))


def write_fasta(seqs: DataFrame, path: str, width: int = 70) -> None:
    fasta_text(seqs, width).select("value").write.text(path)


def number_lines(seqs: DataFrame, width: int = 60, block: int = 10) -> DataFrame:
    """(seq_id, at, line): lines of width letters in blocks, at counted from 1."""
    at = C.starts(F.lit(0), F.length("sequence") - 1, width)
    rows = seqs.select("seq_id", "sequence", F.explode(at).alias("p"))
    line = F.regexp_replace(F.substr("sequence", F.col("p") + 1, F.lit(width)), f"(.{{{block}}})(?=.)", "$1 ")
    return rows.select("seq_id", (F.col("p") + 1).alias("at"), line.alias("line"))


def save_collection(seqs: DataFrame, path: str) -> None:
    seqs.write.mode("overwrite").partitionBy("type").parquet(path)


def load_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def build_collection(rows: DataFrame) -> DataFrame:
    """Rows (seq_id, name, sequence) with letters and stops only, named, typed; empty ones go."""
    own = rows.withColumn("sequence", F.regexp_replace("sequence", "[^A-Za-z*]", "")).where("sequence <> ''")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Untitled"))
    return own.select("seq_id", name.alias("name"), C.detect_type(F.col("sequence")).alias("type"), "sequence")


def annotated(seqs: DataFrame) -> DataFrame:
    """Features of the built-in templates in seqs."""
    return auto_annotate(seqs, refdata.feature_library(seqs.sparkSession))


def import_sequences(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records with seq_id, features): all files, with the features that GenBank files give and those of the built-in
    templates that they do not."""
    records = read_sequences(spark, paths).withColumn("seq_id", F.xxhash64("name", "sequence"))
    given = ["seq_id", "name", "type", "start", "end", "strand"]
    if "features" not in records.columns:
        return records, annotated(records)
    own = records.select("seq_id", F.explode("features").alias("f")).select("seq_id", F.coalesce(F.col("f.qualifiers")["gene"], F.col("f.qualifiers")["product"], "f.type").alias("name"), "f.type", "f.start", "f.end", "f.strand")
    found = auto_annotate(records, refdata.feature_library(spark), own)
    return records, own.select(*given, F.lit("file").alias("source")).unionByName(found, allowMissingColumns=True)
