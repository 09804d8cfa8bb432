"""Skip and allow lists over domain names.

A name matches a list when it equals a full-name entry, or when the *longest* prefix
(suffix) pattern that fits it is still active. Matching is by plain characters and ignores
case.

Short lists become one native expression. Long lists become equi-joins: the distinct names
are matched once against the patterns by hash, whatever the number of log rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namestrata.session import cut_lineage

#: Lists up to this length are one expression; both forms give one answer for any list.
SHORT_LIST = 256

NONE, ALL, SKIP, ALLOW, BOTH = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class ShortList:
    """Patterns of a list known to be short, as plain Python values."""

    rows: tuple[tuple[str, str, int, bool], ...]

    def matches(self, name: Column) -> Column:
        lowered = F.lower(name)
        return (
            self._full(lowered)
            | self._longest("prefix", lambda p: F.startswith(lowered, p))
            | self._longest("suffix", lambda p: F.endswith(lowered, p))
        )

    def _full(self, lowered: Column) -> Column:
        names = sorted(p for role, p, _, active in self.rows if role == "fqdn" and active)
        return lowered.isin(*names) if names else F.lit(False)

    def _longest(self, role: str, fits) -> Column:
        """Longer patterns first; the first that fits decides.

        Once no inactive pattern is left to shadow a shorter one, any fit decides and the
        remaining patterns form a plain OR.
        """
        ordered = sorted(
            ((size, p, active) for r, p, size, active in self.rows if r == role),
            key=lambda t: (-t[0], t[1]),
        )
        if not any(active for _, _, active in ordered):
            return F.lit(False)
        if all(active for _, _, active in ordered):
            return reduce(lambda x, y: x | y, [fits(F.lit(p)) for _, p, _ in ordered])
        decided = F.lit(False)
        for _, pattern, active in reversed(ordered):
            decided = F.when(fits(F.lit(pattern)), F.lit(active)).otherwise(decided)
        return decided


def short_list(patterns: DataFrame | None, most: int = SHORT_LIST) -> ShortList | None:
    """The list as plain values if it has at most ``most`` patterns, else None.

    The size is checked first: no more than ``most + 1`` rows ever reach the driver.
    """
    if patterns is None:
        return ShortList(())
    rows = patterns.select("role", "pattern", "size", "active").limit(most + 1).collect()
    return ShortList(tuple(tuple(r) for r in rows)) if len(rows) <= most else None


def matching_names(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Lower-cased distinct ``name`` values that match a list of any length.

    Every name is expanded to its candidate prefixes and suffixes, limited to the pattern
    lengths that occur, and hash-joined with the patterns.
    """
    sizes = patterns.groupBy().agg(
        F.array_sort(F.collect_set(F.when(F.col("role") == "prefix", F.col("size")))).alias("p"),
        F.array_sort(F.collect_set(F.when(F.col("role") == "suffix", F.col("size")))).alias("s"),
    )
    row = sizes.first()  # at most 255 lengths per role: a name has no more characters
    sides = [
        ("prefix", row["p"], lambda n, size: F.substring(n, F.lit(1), size)),
        ("suffix", row["s"], lambda n, size: F.substring(n, -size, size)),
    ]
    full = patterns.filter("role = 'fqdn' AND active").select(F.col("pattern").alias("name"))
    found = names.join(full, "name", "left_semi").select("name")
    for role, lengths, cut in sides:
        if not lengths:
            continue
        size = F.explode(
            F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("name"))
        )
        candidates = names.select("name", size.alias("size")).select(
            "name", "size", cut(F.col("name"), F.col("size")).alias("pattern")
        )
        wanted = patterns.filter(F.col("role") == role).select("pattern", "active")
        best = (
            candidates.join(wanted, "pattern")
            .groupBy("name")
            .agg(F.max_by("active", "size").alias("active"))
        )
        found = found.unionByName(best.filter("active").select("name"))
    return found.distinct()


def _filter_long(df: DataFrame, column: str, patterns: DataFrame, keep_matches: bool) -> DataFrame:
    names = df.select(F.lower(column).alias("name")).distinct()
    matched = matching_names(names, patterns).withColumnRenamed("name", "__name")
    matched = cut_lineage(matched, "matched-names")
    # Adaptive execution picks the join by the bytes of the matched names and splits hot names;
    # neither semi nor anti join multiplies rows.
    on = F.lower(df[column]) == matched["__name"]
    return df.join(matched, on, "left_semi" if keep_matches else "left_anti")


def filter_domains(
    df: DataFrame,
    mode: int,
    skip: DataFrame | None = None,
    allow: DataFrame | None = None,
    column: str = "Question",
    short: int = SHORT_LIST,
) -> DataFrame:
    """Apply an output mode to rows that carry one name each.

    0 keeps nothing, 1 everything, 2 drops skip-list matches, 3 keeps allow-list matches
    (an empty or missing list keeps nothing), 4 does both; any other mode keeps nothing.
    A NULL name matches no list: skip lists keep it, allow lists drop it.
    """
    if mode == ALL:
        return df
    if mode not in (SKIP, ALLOW, BOTH):
        return df.filter(F.lit(False))
    out = df
    if mode in (SKIP, BOTH):
        plain = short_list(skip, short)
        out = out.filter(~known(plain.matches(F.col(column)))) if plain else _filter_long(out, column, skip, False)
    if mode in (ALLOW, BOTH):
        plain = short_list(allow, short)
        out = out.filter(plain.matches(F.col(column))) if plain else _filter_long(out, column, allow, True)
    return out


def known(match: Column) -> Column:
    return F.coalesce(match, F.lit(False))


def rejected(name: Column, mode: int, skip: ShortList, allow: ShortList) -> Column:
    """Whether a mode rejects a name, as an expression (short lists only)."""
    if mode == ALL:
        return F.lit(False)
    if mode == SKIP:
        return known(skip.matches(name))
    if mode == ALLOW:
        return ~known(allow.matches(name))
    if mode == BOTH:
        return known(skip.matches(name)) | ~known(allow.matches(name))
    return F.lit(True)


def filter_messages(
    results: DataFrame, mode: int, skip: DataFrame | None = None, allow: DataFrame | None = None,
    short: int = SHORT_LIST,
) -> DataFrame:
    """Drop a whole message when any of its questions is rejected; none at all passes.

    With a long list the messages are stored under a number of their own, as no column tells
    them apart over captures and streams.
    """
    skips, allows = short_list(skip, short), short_list(allow, short)
    if skips and allows:
        return results.filter(
            ~F.exists("dns.question", lambda q: rejected(q["name"], mode, skips, allows))
        )
    stored = cut_lineage(results.withColumn("__message", F.monotonically_increasing_id()), "messages")
    asked = stored.select("__message", F.explode("dns.question.name").alias("name"))
    kept = filter_domains(asked, mode, skip, allow, "name", short)
    total = asked.groupBy("__message").agg(F.count(F.lit(1)).alias("__asked"))
    passed = kept.groupBy("__message").agg(F.count(F.lit(1)).alias("__passed"))
    bad = total.join(passed, "__message", "left").filter("coalesce(__passed, 0) < __asked")
    return stored.join(bad.select("__message"), "__message", "left_anti").drop("__message")


def with_questions(results: DataFrame) -> DataFrame:
    """Only messages that carry a question."""
    return results.filter(F.size("dns.question") > 0)


def suffix_filter(df: DataFrame, suffix: str, reversed_column: str = "rq") -> DataFrame:
    """Names ending in ``suffix``, as a prefix test on the stored reversed name.

    The prefix test reaches the Parquet scan and skips row groups; ``endswith`` cannot.
    """
    return df.filter(F.startswith(F.col(reversed_column), F.lit(suffix[::-1])))
