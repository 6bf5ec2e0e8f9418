"""Identifiers of species and sequences: lists in use, ids and names, accessions, headers, and checks of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def species_list(lines: DataFrame) -> DataFrame:
    """(species_id, species, used) of a species list's lines (value): ``id: name``, left out where it starts with ``#``. Blank lines are nothing; a
    line of another form is an error."""
    text = lines.where(F.trim("value") != "").select(F.rtrim("value").alias("value"), F.regexp_replace("value", "^#", "").alias("body"))
    parts = F.split("body", ": ", 2)
    bad = F.raise_error(F.concat(F.lit("not an id and a name: "), "value"))
    return text.select(F.when(F.col("body").rlike(r"^\s*\d+: \S"), F.trim(parts[0]).cast("int")).otherwise(bad.cast("int")).alias("species_id"), F.trim(parts[1]).alias("species"), (~F.col("value").startswith("#")).alias("used"))


def malformed_ids(lines: DataFrame) -> DataFrame:
    """Lines (value) of an id file that aren't ``id: name``; none in a valid one."""
    return lines.where((F.trim("value") != "") & ~F.col("value").rlike(r"^#?\s*\S+: \S"))


def subset_offsets(counts: DataFrame, used: DataFrame) -> DataFrame:
    """(species_id, n, start) of the species in use; starts are counted anew. Both are a row a species."""
    kept = counts.join(used.select("species_id"), "species_id", "left_semi")
    before = kept.select(F.col("species_id").alias("other"), F.col("n").alias("m"))
    return kept.join(before, F.col("other") < F.col("species_id"), "left").groupBy("species_id", "n").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("start"))


def pair_ids(single: DataFrame, offsets: DataFrame) -> DataFrame:
    """(id) -> (id, species_id, seq_idx): the species whose range of numbers holds an id. ``offsets`` is a row a species."""
    ranges = F.broadcast(offsets)
    return single.join(ranges, (F.col("id") >= F.col("start")) & (F.col("id") < F.col("start") + F.col("n"))).select("id", "species_id", (F.col("id") - F.col("start")).alias("seq_idx"))


def prefixed(species: Column, accession: Column) -> Column:
    """``Species_accession`` with dots and spaces of the species as ``_``."""
    return F.concat_ws("_", F.translate(species, ". ", "__"), accession)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def accession_index(rows: DataFrame, key: str = "accession", value: str = "id", sentinel: str = "inf_inf") -> DataFrame:
    """(key, value): an accession's id; ``sentinel`` where it has several."""
    found = rows.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(F.col(value).cast("string")).alias("one"))
    return found.select(key, F.when(F.col("n") > 1, sentinel).otherwise(F.col("one")).alias(value))


def header_tags(headers: DataFrame) -> DataFrame:
    """(tag, id, n) of the ``tag:id`` words of headers (header)."""
    words = headers.select(F.explode(F.filter(F.split(F.rtrim("header"), r"\s+"), lambda w: w.contains(":"))).alias("w"))
    return words.select(F.substring_index("w", ":", 1).alias("tag"), F.expr("substring(w, instr(w, ':') + 1)").alias("id")).groupBy("tag", "id").agg(F.count(F.lit(1)).alias("n"))


def is_refseq(header: Column) -> Column:
    """Whether a header is of the NCBI form: a two-letter protein prefix and a bracketed organism at its end."""
    return F.rtrim(header).rlike(r"^(NP|XP|YP|WP)_.*\]$")


def isoform_free(header: Column) -> Column:
    """A header without its isoform's name; one that had it loses its own accession too, so that isoforms of a gene are equal."""
    short = F.regexp_replace(header, r"isoform X?[0-9, A-Z]+ ", "")
    return F.when(short != header, F.regexp_replace(short, r"^\s*\S+\s+", "")).otherwise(header)


def natural_key(column: Column) -> Column:
    """Orders text with numbers by their values: digits are padded to twenty places, letters are lower-cased."""
    runs = F.regexp_extract_all(F.lower(column), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(r)), "")


def gaps(ids: DataFrame) -> DataFrame:
    """(species_id, n, last) of species whose ``seq_idx`` isn't 0, 1, ... without a gap; none in a valid run."""
    seen = ids.groupBy("species_id").agg(F.count_distinct("seq_idx").alias("n"), F.max("seq_idx").alias("last"), F.min("seq_idx").alias("first"))
    return seen.where("first <> 0 or last + 1 <> n").drop("first")


def missing_pairs(species: DataFrame, pairs: DataFrame, both_ways: bool = True) -> DataFrame:
    """(query, target) searches between the species (id) that ``pairs`` doesn't have; one way is query <= target. A row a pair of species."""
    a, b = species.select(F.col("id").alias("query")), species.select(F.col("id").alias("target"))
    want = a.join(b, F.lit(True) if both_ways else F.col("query") <= F.col("target"))
    return want.join(pairs.select("query", "target"), ["query", "target"], "left_anti")


def tree_problems(leaves: DataFrame, species: DataFrame) -> DataFrame:
    """(name, problem) of a user's species tree (name rows of its leaves): repeated, unknown and missing species."""
    again = duplicates(leaves, "name").select("name", F.lit("repeated").alias("problem"))
    unknown = leaves.join(species, "name", "left_anti").select("name", F.lit("unknown").alias("problem")).distinct()
    missing = species.join(leaves, "name", "left_anti").select("name", F.lit("missing").alias("problem"))
    return again.union(unknown).union(missing)


def incomplete_metadata(metadata: DataFrame, species: DataFrame) -> DataFrame:
    """Species in use that a metadata table (species and four more columns) doesn't name; a table of another width is an error."""
    if len(metadata.columns) != 5:
        raise ValueError(f"species metadata has five columns, not {len(metadata.columns)}")
    return species.join(metadata.select(F.col(metadata.columns[0]).alias("species")), "species", "left_anti")
