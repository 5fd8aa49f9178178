"""Which files belong into a pack: ignore rules, includes, sizes, manifests, roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions import glob
from sheaf.functions.text import ancestors, base_name, byte_view, col, lines, parent_dir, rows_of, trim_space
from sheaf.operators.joins import salted_lookup
from sheaf.operators.rule_index import all_scopes, ignored_paths, indexed, self_and_above
from sheaf.session import drop_table, store_table

TOOL_NAME = "sheaf"


def default_ignores(tool_name: str = TOOL_NAME) -> list[str]:
    """The built-in patterns; the tool's earlier output files go by its name."""
    return [*fv.IGNORE_PATTERNS, f"**/{tool_name}-output.*", *fv.OTHER_TOOL_OUTPUTS]


def ignore_file_names(tool_name: str = TOOL_NAME, gitignore: bool = True, dot_ignore: bool = True) -> list[str]:
    return [".gitignore"] * gitignore + [".ignore", f".{tool_name}ignore"] * dot_ignore


# --- rules ------------------------------------------------------------------------------


def scan_ignore_rules(corpus: DataFrame, tool_name: str = TOOL_NAME, **names: bool) -> DataFrame:
    """Rules of all ignore files in a corpus, one row each.

    A rule's place is ``(scope_dir, file_ord, line_no)``: outer directories come
    before inner ones, then the files in their fixed order, then the lines. That
    order is a key, so no global numbering (and no single task) is needed.
    """
    wanted = ignore_file_names(tool_name, **names)
    file_ord = F.array_position(F.array(*[F.lit(n) for n in wanted]), base_name("rel_path")).cast("int")
    files = corpus.where(base_name("rel_path").isin(wanted)).select(
        parent_dir("rel_path").alias("scope_dir"), file_ord.alias("file_ord"), "content"
    )
    parsed = files.select(
        "scope_dir",
        "file_ord",
        F.posexplode_outer(F.transform(lines("content"), glob.parse_rule_col)).alias("pos", "rule"),
    )
    return parsed.where("rule is not null").select(
        "scope_dir",
        "file_ord",
        (F.col("pos") + 1).alias("line_no"),
        "rule.pattern",
        "rule.negate",
        "rule.dir_only",
        "rule.anchored",
        glob.rule_regex_col("rule.pattern", "rule.anchored").alias("regex"),
    )


# --- stated rules: no join at all -------------------------------------------------------


def is_ignored(path: str | Column, patterns: list[str], is_dir: bool = False) -> Column:
    """The verdict of an ordered rule list on one path; the last matching rule wins."""
    verdict = glob.last_match(byte_view(path), is_dir, glob.parse_rules(patterns))
    return F.coalesce(verdict, F.lit(False))


def below_ignored_dir(path: str | Column, patterns: list[str]) -> Column:
    """True where some directory above the path is ignored; nothing below it can come back."""
    return F.exists(ancestors(path), lambda d: is_ignored(d, patterns, is_dir=True))


def ignore_filter(files: DataFrame, patterns: list[str], path: str = "rel_path") -> DataFrame:
    return files.where(~is_ignored(path, patterns))


def ignored_dir_prune(files: DataFrame, patterns: list[str], path: str = "rel_path") -> DataFrame:
    return files.where(~below_ignored_dir(path, patterns))


def include_filter(files: DataFrame, patterns: list[str], path: str = "rel_path") -> DataFrame:
    """Files that match any pattern; an empty list passes all. Patterns ending in ``/`` match no file."""
    if not patterns:
        return files
    if any(not p.strip() for p in patterns):
        raise ValueError("include patterns must be non-empty strings")
    rules = [r for r in glob.parse_rules(patterns) if not r.dir_only]
    return files.where(byte_view(path).rlike(glob.whole([r.regex for r in rules])))


def max_size_filter(files: DataFrame, limit: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """Drop files larger than ``limit`` bytes; 0 turns the limit off."""
    if limit < 0:
        raise ValueError("the size limit must not be negative")
    return files.where(F.col("bytes") <= limit) if limit else files


# --- rules found in the corpus ----------------------------------------------------------



def nested_ignores(files: DataFrame, rules: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """Apply stated ``patterns`` and the ``rules`` of ``scan_ignore_rules`` together.

    A rule acts on what lies below its own directory and is matched against the path
    from there. Stated patterns come first, so any rule from a file outranks them.
    Every distinct directory is judged once. Verdicts are made on paths alone; files meet the paths to drop at the end.
    """
    stated = list(patterns)
    rules = store_table(indexed(rules))
    paths = files.select(F.col("rel_path").alias("path"), parent_dir("rel_path").alias("dir"))
    chain = store_table(paths.select("dir").distinct().select("dir", F.posexplode_outer(self_and_above("dir")).alias("depth", "scope_dir")))
    dirs = chain.where("scope_dir <> ''").select(F.col("scope_dir").alias("path")).distinct()
    gone = ignored_paths(dirs, all_scopes(dirs), rules, is_ignored("path", stated, True), True)
    # What is known of a directory, for all below it: that it goes, that it has rules.
    facts = gone.select(F.col("path").alias("scope_dir"), F.lit(True).alias("goes"), F.lit(False).alias("rules"))
    facts = facts.unionByName(rules.select("scope_dir", F.lit(False).alias("goes"), F.lit(True).alias("rules")))
    facts = facts.groupBy("scope_dir").agg(F.max("goes").alias("goes"), F.max("rules").alias("rules"))
    known = salted_lookup(chain, facts, on="scope_dir", how="inner", spread="dir").groupBy("dir").agg(
        F.max("goes").alias("gone"), F.array_compact(F.collect_list(F.when(F.col("rules"), F.struct("depth", "scope_dir")))).alias("scopes")
    )
    placed = store_table(salted_lookup(paths, known, on="dir", spread="path").select("path", F.coalesce("gone", F.lit(False)).alias("gone"), "scopes"))
    kept = placed.where("not gone")
    scoped = kept.select("path", F.explode("scopes").alias("_s")).select("path", "_s.*")
    ignored = ignored_paths(kept, scoped, rules, is_ignored("path", stated), False)
    dropped = store_table(placed.where("gone").select("path").unionByName(ignored))
    for used in (rules, chain, placed):
        drop_table(used)
    return files.join(dropped.withColumnRenamed("path", "rel_path"), "rel_path", "left_anti").select(*files.columns)


def unignored_dirs(dirs: DataFrame, rules: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """The directories that neither ``rules`` of ignore files above them nor stated ``patterns`` ignore.

    What lies above a directory is not looked at: a walk only comes to directories whose own were kept.
    """
    paths = dirs.select(F.col("rel_path").alias("path")).distinct()
    ignored = ignored_paths(paths, all_scopes(paths), indexed(rules), is_ignored("path", list(patterns), True), True)
    return dirs.join(ignored.withColumnRenamed("path", "rel_path"), "rel_path", "left_anti").select(*dirs.columns)


# --- lists of paths and several roots ---------------------------------------------------


def manifest_paths(manifest: DataFrame, line: str = "line") -> DataFrame:
    """Entries of a manifest: trimmed, without blank and ``#`` lines, each once."""
    entry = trim_space(line)
    return manifest.select(entry.alias("entry")).where((F.col("entry") != "") & ~F.col("entry").startswith("#")).distinct()


def select_manifest(files: DataFrame, manifest: DataFrame, line: str = "line") -> DataFrame:
    """Files that a manifest names, or that lie below a directory it names.

    The list is joined with every path's ancestors on narrow rows, and only the paths
    that survive meet the contents again.
    """
    entries = manifest_paths(manifest, line)
    if entries.isEmpty():
        raise ValueError("the manifest names no paths")
    chain = F.concat(ancestors("rel_path"), F.array("rel_path"))
    reached = files.select("rel_path", rows_of(chain).alias("entry"))
    selected = salted_lookup(reached, entries, on="entry", how="left_semi", spread="rel_path")
    return files.join(selected.select("rel_path").distinct(), "rel_path", "left_semi")


def union_roots(roots: list[DataFrame], path: str = "abs_path") -> DataFrame:
    """Files of several roots; of a path that occurs more than once the first root's row stays.

    A rank of one over the path is trimmed before the shuffle (window group limit), so
    many copies of one path do not travel.
    """
    tagged = None
    for i, root in enumerate(roots):
        part = root.withColumn("_root", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = F.row_number().over(Window.partitionBy(col(path)).orderBy("_root"))
    return tagged.withColumn("_rank", first).where("_rank = 1").drop("_rank", "_root")
