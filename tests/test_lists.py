"""Domain lists against a plain Python matcher."""

import random

import pytest

from namestrata.operators.domain_filter import filter_domains, filter_messages
from namestrata.sources.domain_lists import domain_list_from, load_domain_list


def load(lines):
    """Kinds, prefixes and suffixes as a list is read line by line."""
    kinds, prefixes, suffixes = {}, set(), set()
    for line in lines:
        parts = line.lower().split(",")
        if len(parts) != 2:
            parts = [line.lower(), "fqdn"]
        if parts[1] == "prefix":
            kinds[parts[0]] = "prefix"
            prefixes.add(parts[0])
        elif parts[1] == "suffix":
            kinds[parts[0][::-1]] = "suffix"
            suffixes.add(parts[0][::-1])
        else:
            kinds[parts[0]] = "fqdn"
    return kinds, prefixes, suffixes


def matches(name, loaded):
    kinds, prefixes, suffixes = loaded
    name = name.lower()
    if kinds.get(name) == "fqdn":
        return True
    for text, patterns, kind in ((name, prefixes, "prefix"), (name[::-1], suffixes, "suffix")):
        fitting = [p for p in patterns if p and text.startswith(p)]
        if fitting and kinds[max(fitting, key=len)] == kind:
            return True
    return False


def random_case(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab.") for _ in range(rng.randrange(1, n)))
    names = [word(9) for _ in range(60)] + ["AB.a", "a"]
    kinds = ["prefix", "suffix", "fqdn", "other", ""]
    lines = [f"{word(5)},{rng.choice(kinds)}" for _ in range(25)] + ["ab.a", "a,b,c", "BA,prefix"]
    rng.shuffle(lines)
    return names, lines


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("short", [0, 256])
def test_modes(spark, seed, short):
    names, lines = random_case(seed)
    loaded = load(lines)
    df = spark.createDataFrame([(n,) for n in names], "Question string")
    patterns = domain_list_from(spark, lines)
    skipped = sorted(n for n in names if not matches(n, loaded))
    allowed = sorted(n for n in names if matches(n, loaded))
    got = lambda mode, **k: sorted(r[0] for r in filter_domains(df, mode, short=short, **k).collect())
    assert got(2, skip=patterns) == skipped
    assert got(3, allow=patterns) == allowed
    assert got(4, skip=patterns, allow=patterns) == []
    assert got(0) == got(5) == got(3) == []
    assert got(1) == sorted(names)


def test_matching_is_by_character(spark):
    df = spark.createDataFrame([("notgoogle.com.",), ("google.org.",)], "Question string")
    kept = filter_domains(df, 2, domain_list_from(spark, ["google.com.,suffix"]))
    assert [r[0] for r in kept.collect()] == ["google.org."]


def test_list_file_order_and_line_ends(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_bytes(b"A.b.,prefix\r\na.b.,fqdn\r\nc.,suffix\r\n")
    rows = {(r.role, r.pattern, r.active) for r in load_domain_list(spark, str(path)).collect()}
    assert rows == {("prefix", "a.b.", False), ("fqdn", "a.b.", True), ("suffix", "c.", True)}


@pytest.mark.parametrize("short", [0, 256])
def test_whole_messages(spark, short):
    df = spark.sql(
        "SELECT 1L AS seq, named_struct('question', array(named_struct('name', 'x.'), named_struct('name', 'bad.'))) AS dns "
        "UNION ALL SELECT 2L, named_struct('question', array(named_struct('name', 'x.'), named_struct('name', 'y.'))) "
        "UNION ALL SELECT 3L, named_struct('question', CAST(array() AS array<struct<name: string>>))"
    )
    kept = filter_messages(df, 2, domain_list_from(spark, ["bad.,fqdn"]), short=short)
    assert sorted(r.seq for r in kept.collect()) == [2, 3]


@pytest.mark.parametrize("short", [0, 256])
def test_messages_of_several_captures(spark, short):
    """Record numbers restart per capture; a rejected message takes no other with it."""
    df = spark.sql(
        "SELECT 'a' AS file, 0L AS seq, named_struct('question', array(named_struct('name', 'bad.'))) AS dns "
        "UNION ALL SELECT 'b', 0L, named_struct('question', array(named_struct('name', 'good.'))) "
        "UNION ALL SELECT 'b', 0L, named_struct('question', array(named_struct('name', CAST(NULL AS string))))"
    )
    kept = filter_messages(df, 2, domain_list_from(spark, ["bad.,fqdn"]), short=short)
    assert sorted((r.file, r.dns.question[0].name or "") for r in kept.collect()) == [("b", ""), ("b", "good.")]


@pytest.mark.parametrize("short", [0, 256])
def test_missing_names(spark, short):
    df = spark.createDataFrame([("bad.",), (None,), ("x.",)], "Question string")
    patterns = domain_list_from(spark, ["bad.,fqdn"])
    got = lambda mode, **k: sorted(r[0] or "" for r in filter_domains(df, mode, short=short, **k).collect())
    assert got(2, skip=patterns) == ["", "x."]
    assert got(3, allow=patterns) == ["bad."]
    assert got(4, skip=patterns, allow=patterns) == []
