"""Search over a catalogue: filter, order, number, page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import limits
from ..errors import InvalidArgument
from ..functions import scalars
from ..functions.fold import fold, nfc, nfc_folded
from ..plans.compiler import Options, Plan, compile_query
from ..workspace import materialize
from . import tree
from .ranks import number

_KEYS = {"name": "folded", "size": "size", "mtime": "mtime_secs"}


@dataclass(frozen=True)
class Catalogue:
    """entries: volume, volume_ord, entry_id, frn, parent_frn, name, folded, is_dir, hidden, system,
    tombstone, size, mtime_secs, is_excluded, nfc_name, nfc_folded. paths: volume, frn, path, excluded
    of directories, with folded, nfc and nfc_folded paths. Canonical spellings are null where they are
    the plain one, as nearly all are."""

    entries: DataFrame
    paths: DataFrame


def _if_other(spelling: Column, plain: str) -> Column:
    return F.when(spelling != F.col(plain), spelling)


def spell_entries(entries: DataFrame) -> DataFrame:
    """entries (with name and folded) and their canonical spellings."""
    name = F.col("name")
    return entries.withColumn("nfc_name", _if_other(nfc(name), "name")).withColumn("nfc_folded", _if_other(nfc_folded(name), "folded"))


def spell_paths(closed: DataFrame) -> DataFrame:
    """Directories (with path) and their path's other spellings."""
    path = F.col("path")
    return closed.withColumn("folded", fold(path)).withColumn("nfc", _if_other(nfc(path), "path")).withColumn("nfc_folded", _if_other(nfc_folded(path), "folded"))


def build(raw: DataFrame, strict: bool = False) -> Catalogue:
    """Fold the names, close the directories, inherit visibility, spell canonically; written once, searched often."""
    raw = materialize(raw.withColumn("folded", fold(F.col("name"))), "raw")
    closed = tree.close_directories(raw, strict)
    entries = spell_entries(tree.with_excluded(raw, closed))
    return Catalogue(materialize(entries, "entries"), materialize(spell_paths(closed), "paths"))


def filtered(catalogue: Catalogue, plan: Plan) -> DataFrame:
    """The entries that match; paths and canonical names are made only for plans that ask for them."""
    rows = catalogue.entries.where(~F.col("tombstone"))
    if not plan.options.include_hidden_system:
        rows = rows.where(~F.col("is_excluded"))
    if plan.needs_paths:
        # a separator is a barrier to folding and composition alike, so paths are spelled part by part
        rows = tree.with_paths(rows, catalogue.paths, "folded", "nfc", "nfc_folded").withColumn("folded_path", tree.below("w_folded", F.col("folded")))
        if plan.needs_canonical:
            rows = rows.withColumn("nfc_path", tree.below(F.coalesce("w_nfc", "w_path"), F.coalesce("nfc_name", "name")))
            rows = rows.withColumn("nfc_folded_path", tree.below(F.coalesce("w_nfc_folded", "w_folded"), F.coalesce("nfc_folded", "folded")))
    if plan.needs_canonical:
        rows = rows.withColumn("nfc_name", F.coalesce("nfc_name", "name")).withColumn("nfc_folded", F.coalesce("nfc_folded", "folded"))
    kept = rows.where(plan.condition()).select(*catalogue.entries.columns)
    if plan.needs_canonical:  # as they are stored
        kept = kept.withColumn("nfc_name", _if_other(F.col("nfc_name"), "name")).withColumn("nfc_folded", _if_other(F.col("nfc_folded"), "folded"))
    return kept


def order(options: Options) -> list[Column]:
    """The key, then the earlier volume in either direction, then the entry in the key's direction."""
    key, entry = F.col(_KEYS[options.sort]), F.col("entry_id")
    return [key.desc(), F.col("volume_ord"), entry.desc()] if options.desc else [key, F.col("volume_ord"), entry]


def search(catalogue: Catalogue, text: str, options: Options = Options()) -> DataFrame:
    """Matching entries in their order; Spark sorts by range partitions over the whole cluster."""
    plan = compile_query(text, options)
    return filtered(catalogue, plan).orderBy(*order(options))


def count(catalogue: Catalogue, text: str, options: Options = Options()) -> int:
    return filtered(catalogue, compile_query(text, options)).count()


def top(catalogue: Catalogue, text: str, n: int = limits.MAX_PAGE_ROWS, options: Options = Options(), offset: int = 0) -> DataFrame:
    """n entries from an offset with pos, without ordering the rest: each task keeps offset + n rows."""
    if offset < 0 or n < 0:
        raise InvalidArgument("negative offset or count")
    rows = filtered(catalogue, compile_query(text, options)).orderBy(*order(options)).limit(offset + n)
    # at most offset + n rows come here, so one window over them is bounded
    numbered = rows.withColumn("pos", F.row_number().over(Window.orderBy(*order(options))).cast("long") - 1)
    return numbered.where(F.col("pos") >= offset)


def positions(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """rows with pos, their place in the order, from 0."""
    return number(rows, order(options))


def projected(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """The boundary row: entry_ref, frn, size, mtime (file time), flags (bit 0: directory), name, parent_path; pos where present."""
    full = tree.with_paths(rows, paths)
    flags = F.when(F.col("is_dir"), 1).otherwise(0)
    columns = [scalars.entry_ref(F.col("volume_ord"), F.col("entry_id")).alias("entry_ref"), "frn", "size", scalars.ticks_of(F.col("mtime_secs")).alias("mtime"), flags.alias("flags"), "name", "parent_path"]
    return full.select(*(["pos"] if "pos" in rows.columns else []), *columns)


def page(numbered: DataFrame, paths: DataFrame, offset: int, n: int = limits.MAX_PAGE_ROWS) -> DataFrame:
    """Rows [offset, offset + n) of a numbered result; n is held at the page limit, past the end is empty."""
    n = min(n, limits.MAX_PAGE_ROWS)
    return projected(numbered.where(F.col("pos").between(offset, offset + n - 1)), paths)


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    """Whether two numbered results list the same entries in the same order."""
    a = before.select("pos", F.col("volume_ord").alias("va"), F.col("entry_id").alias("a"))
    b = after.select("pos", F.col("volume_ord").alias("vb"), F.col("entry_id").alias("b"))
    return a.join(b, "pos", "full_outer").where(~(F.col("a").eqNullSafe(F.col("b")) & F.col("va").eqNullSafe(F.col("vb")))).isEmpty()
