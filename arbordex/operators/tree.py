"""The parent tree: resolving parents, full paths and inherited visibility.

Paths are closed over directories alone, by pointer doubling: after k joins every directory knows its
ancestor 2^k levels up, so the number of joins is the logarithm of the depth. Files join their
directory's path once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TopologyError
from ..limits import MAX_PATH_BYTES
from ..workspace import materialize

ROOT_RECORD = 5


def directories(entries: DataFrame) -> DataFrame:
    """volume, frn, parent_frn, name, own_excluded of the live directories."""
    own = (F.col("hidden") | F.col("system")).alias("own_excluded")
    return entries.where("is_dir and not tombstone").select("volume", "frn", "parent_frn", "name", own)


#: Rows that have not come to the top of their volume, nor to a parent that is missing.
_UNDER_WAY = "up is not null and not orphan"


def _double(state: DataFrame) -> DataFrame:
    above = state.select(F.col("volume").alias("a_volume"), F.col("frn").alias("a_frn"), F.col("up").alias("a_up"), F.col("path").alias("a_path"), F.col("excluded").alias("a_excluded"), F.col("chain").alias("a_chain"))
    joined = state.where(_UNDER_WAY).join(above, (F.col("volume") == F.col("a_volume")) & (F.col("up") == F.col("a_frn")), "left")
    found = F.col("a_frn").isNotNull()
    moved = joined.select(
        "volume",
        "frn",
        F.when(found, F.col("a_up")).otherwise(F.col("up")).alias("up"),
        F.when(found, F.concat_ws("\\", "a_path", "path")).otherwise(F.col("path")).alias("path"),
        (F.col("excluded") | F.coalesce("a_excluded", F.lit(False))).alias("excluded"),
        (F.col("up").isNotNull() & ~found).alias("orphan"),
        F.when(found, F.concat("a_chain", "chain")).otherwise(F.col("chain")).alias("chain"),
    )
    return state.where(f"not ({_UNDER_WAY})").select(*moved.columns).unionByName(moved)


def link(frn: Column) -> Column:
    """A directory's part of the chains of all below it: of one length, so that a chain's prefixes are ancestors."""
    return F.concat(F.lpad(F.hex(frn), 16, "0"), F.lit("/"))


#: Characters of a link.
LINK = 17


def close_states(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed, looping) of rows (volume, frn, up, path, excluded, orphan, chain) whose up is another row's frn, or null at the top.

    Each round ends the directories that are up to twice as far below their end. If it ends none, no other
    is that far from an end, and those that are left have none: their paths, which double with each round,
    grow no further.
    """
    left = None
    while True:
        state = materialize(_double(state), "tree")
        before, left = left, state.where(_UNDER_WAY).select("volume", "frn").distinct().count()
        if left == 0 or left == before:
            return state.where("up is null and not orphan"), state.where(_UNDER_WAY)


def _on_cycles(looping: DataFrame) -> DataFrame:
    """volume, frn of the directories on the cycles to which looping rows (volume, frn, up) lead.

    Each round doubles the steps from a row to its up. When two rounds give as many distinct ups, those steps
    map the set of ups onto itself, so it holds what lies on cycles alone.
    """
    steps = looping.select("volume", "frn", "up")
    n = None
    while True:
        ups = materialize(steps.select("volume", F.col("up").alias("frn")).distinct(), "ups")
        before, n = n, ups.count()
        if n == before:
            return ups
        above = steps.select("volume", F.col("frn").alias("up"), F.col("up").alias("a_up"))
        steps = materialize(steps.join(above, ["volume", "up"]).select("volume", "frn", F.col("a_up").alias("up")).distinct(), "steps")


def _close(dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed, looping): directories that reach a root, and those whose ancestors never end."""
    return close_states(dirs.select("volume", "frn", F.col("parent_frn").alias("up"), F.col("name").alias("path"), F.col("own_excluded").alias("excluded"), F.lit(False).alias("orphan"), link(F.col("frn")).alias("chain")))


def close_directories(entries: DataFrame, strict: bool = False) -> DataFrame:
    """volume, frn, path, excluded, chain (the links of its ancestors and its own) of every live directory.

    excluded: hidden or system itself, or below such a directory. Directories without a way to the
    root (their parent is missing or no directory) and those in a cycle hang at their volume's root;
    strict raises TopologyError for them instead. A path is the volume's label, then names, joined
    by backslashes.
    """
    dirs = materialize(directories(entries), "dirs")
    parents = dirs.select(F.col("volume").alias("p_volume"), F.col("frn").alias("p_frn"))
    lost = dirs.where("parent_frn is not null").join(parents, (F.col("volume") == F.col("p_volume")) & (F.col("parent_frn") == F.col("p_frn")), "left_anti")
    closed, looping = _close(dirs)
    n_lost, n_loops = lost.count(), looping.count()
    if not n_lost and not n_loops:
        return _checked(closed, strict)
    if strict:
        raise TopologyError(f"{n_lost} directories without a parent, {n_loops} in or below a cycle")
    cut = lost.select("volume", "frn")
    if n_loops:
        cut = cut.unionByName(_on_cycles(dirs.join(looping.select("volume", "frn"), ["volume", "frn"], "left_semi").select("volume", "frn", F.col("parent_frn").alias("up"))))
    roots = dirs.where("parent_frn is null").select("volume", F.col("frn").alias("root_frn"))
    cut = cut.distinct().join(roots, "volume").select(F.col("volume").alias("c_volume"), F.col("frn").alias("c_frn"), "root_frn")
    repaired = dirs.join(cut, (F.col("volume") == F.col("c_volume")) & (F.col("frn") == F.col("c_frn")), "left")
    repaired = repaired.withColumn("parent_frn", F.coalesce("root_frn", "parent_frn")).drop("c_volume", "c_frn", "root_frn")
    return _checked(_close(materialize(repaired, "dirs"))[0], strict)


def _checked(closed: DataFrame, strict: bool) -> DataFrame:
    if strict and not closed.where(F.octet_length("path") > MAX_PATH_BYTES).isEmpty():
        raise TopologyError("a path is too long")
    return closed.select("volume", "frn", "path", "excluded", "chain")


def resolve_parents(entries: DataFrame) -> DataFrame:
    """The rows whose ancestors are all live directories; others, and what hangs from them, are dropped.

    A parent is matched by its full reference and must be a directory; one that is its own parent or
    ambiguous raises TopologyError.
    """
    twice = directories(entries).groupBy("volume", "frn").count().where("count > 1")
    if not twice.isEmpty() or not entries.where("parent_frn = frn").isEmpty():
        raise TopologyError("ambiguous or self parent")
    closed, looping = _close(materialize(directories(entries), "dirs"))
    if not looping.isEmpty():
        raise TopologyError("cycle of directories")
    known = closed.select(F.col("volume").alias("k_volume"), F.col("frn").alias("k_frn"))
    parent = entries.where("parent_frn is not null").join(known, (F.col("volume") == F.col("k_volume")) & (F.col("parent_frn") == F.col("k_frn")), "left_semi")
    return entries.where("parent_frn is null").unionByName(parent)


def resolve_or_root(entries: DataFrame) -> DataFrame:
    """entries with parent_frn repaired: the exact directory, else one with the same record number, else the root."""
    dirs = directories(entries).groupBy("volume", "frn").agg(F.lit(1).alias("one"))
    exact = dirs.select(F.col("volume").alias("e_volume"), F.col("frn").alias("e_frn"))
    by_record = dirs.groupBy(F.col("volume").alias("r_volume"), F.expr(f"frn & {(1 << 48) - 1}").alias("r_record")).agg(F.max("frn").alias("r_frn"))
    roots = entries.where("parent_frn is null").groupBy(F.col("volume").alias("o_volume")).agg(F.min("frn").alias("o_frn"))
    rows = entries.join(exact, (F.col("volume") == F.col("e_volume")) & (F.col("parent_frn") == F.col("e_frn")), "left")
    rows = rows.join(by_record, (F.col("volume") == F.col("r_volume")) & (F.expr(f"parent_frn & {(1 << 48) - 1}") == F.col("r_record")), "left")
    rows = rows.join(roots, F.col("volume") == F.col("o_volume"), "left")
    fixed = F.when(F.col("parent_frn").isNotNull(), F.coalesce("e_frn", "r_frn", "o_frn"))
    return rows.withColumn("parent_frn", fixed).select(*entries.columns)


def with_excluded(entries: DataFrame, closed: DataFrame) -> DataFrame:
    """entries with is_excluded: own hidden or system, or the parent directory's exclusion."""
    above = closed.select(F.col("volume").alias("x_volume"), F.col("frn").alias("x_frn"), F.col("excluded").alias("x_excluded"))
    rows = entries.join(above, (F.col("volume") == F.col("x_volume")) & (F.col("parent_frn") == F.col("x_frn")), "left")
    own = F.col("hidden") | F.col("system")
    return rows.withColumn("is_excluded", own | F.coalesce("x_excluded", F.lit(False))).select(*[c for c in entries.columns if c != "is_excluded"], "is_excluded")


def below(parent: Column | str, name: Column) -> Column:
    """The path of a name below a parent's path; that of a root, which has no parent, is its name."""
    parent = F.col(parent) if isinstance(parent, str) else parent
    return F.when(parent.isNull(), name).otherwise(F.concat(parent, F.lit("\\"), name))


def with_paths(entries: DataFrame, closed: DataFrame, *spellings: str) -> DataFrame:
    """entries with parent_path (it ends with a backslash, and is empty for a root) and path.

    spellings: columns of closed that come along, as w_ and their names, beside w_path.
    """
    above = closed.select(F.col("volume").alias("w_volume"), F.col("frn").alias("w_frn"), *[F.col(c).alias(f"w_{c}") for c in ("path", *spellings)])
    rows = entries.join(above, (F.col("volume") == F.col("w_volume")) & (F.col("parent_frn") == F.col("w_frn")), "left")
    parent = F.when(F.col("w_path").isNull(), "").otherwise(F.concat(F.col("w_path"), F.lit("\\")))
    rows = rows.withColumn("parent_path", parent).withColumn("path", F.concat("parent_path", "name")).drop("w_volume", "w_frn")
    return rows if spellings else rows.drop("w_path")
