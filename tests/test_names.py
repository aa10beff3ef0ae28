"""Fuzzy names against taking turns with all names of the parent."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from surveyspark.operators import joins as J


def slow(left, right, cutoff, one_to_one):
    out = []
    for block in {x for x, _ in left}:
        norm = lambda rows: {n.strip(" ").upper(): min(m for g, m in rows if g == block and m is not None and m.strip(" ").upper() == n.strip(" ").upper()) for g, n in rows if g == block and n is not None}  # noqa: B023, E731
        a, b = norm(left), norm(right)
        out += [(block, a[x], b[x], 1.0) for x in a if x in b]
        rest = {y for y in b if not one_to_one or y not in a}
        for x in sorted(x for x in a if x not in b):
            found = [(r, y) for y in rest if (r := SequenceMatcher(None, y, x).ratio()) >= cutoff]
            if found:
                score, best = max(found)
                out.append((block, a[x], b[best], score))
                if one_to_one:
                    rest.discard(best)
    return out


def worn(rnd, name):
    letters = list(name)
    for _ in range(rnd.randint(0, 4)):
        at = rnd.randrange(len(letters)) if letters else 0
        letters[at : at + rnd.randint(0, 2)] = rnd.choice([[], ["x"], list("ab"), [" "]])
    return "".join(letters)


@pytest.mark.parametrize("cutoff", [0.5, 0.6, 0.85, 1.0])
@pytest.mark.parametrize("one_to_one", [True, False])
def test_fuzzy_match(spark, cutoff, one_to_one):
    rnd = random.Random(int(cutoff * 100))
    make = lambda: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 3)))
    left = [(rnd.choice("pqr"), make()) for _ in range(70)]
    right = [(g, worn(rnd, n)) for g, n in left if rnd.random() < 0.9] + [(rnd.choice("pqr"), make()) for _ in range(20)]
    left += [("p", " abc "), ("p", "ABC"), ("q", None), ("z", "alone"), ("p", "")]
    right += [("p", "abc"), ("q", None), ("p", "  "), ("y", "alone")]
    df = lambda rows: spark.createDataFrame(rows, "g string, name string")
    got = [tuple(r) for r in J.fuzzy_match(df(left), df(right), "g", cutoff, one_to_one).collect()]
    assert sorted(got) == sorted(slow(left, right, cutoff, one_to_one))


def test_names_that_are_found_are_not_looked_for_again(spark, monkeypatch):
    seen, search = [], J.similar_names
    monkeypatch.setattr(J, "similar_names", lambda a, b, cutoff: seen.append((cutoff, a.count())) or search(a, b, cutoff))
    df = lambda names: spark.createDataFrame([("g", n) for n in names], "g string, name string")
    left, right = ["abcdefghijklmnopqrst1", "abcdefghij99"], ["abcdefghijklmnopqrst2", "abcdefghij"]
    got = {r.left_name: r.right_name for r in J.fuzzy_match(df(left), df(right), "g", 0.75, one_to_one=False).collect()}
    assert got == dict(zip(left, right, strict=True))
    assert seen[0] == (0.94, 2) and seen[-1][1] == 1


def test_matched_letters():
    rnd = random.Random(5)
    for letters in ("ab", "abcdef", "aé€ "):
        for _ in range(400):
            x, y = ("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in "xy")
            assert J._matched(x, y) == sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks())


def numbered(seed, n=120):
    rnd = random.Random(seed)
    return [("g", f"School {rnd.randrange(10_000):04d}") for _ in range(n)] + [("g", f"School no {rnd.randrange(100):02d}") for _ in range(9)] + [("h", f"School {rnd.randrange(100):02d}") for _ in range(9)]


@pytest.mark.parametrize(("ways", "met"), [(1000, {"rests", "tiles"}), (1, {"letters", "tiles"}), (0, {"tiles"})])
@pytest.mark.parametrize("one_to_one", [True, False])
def test_ways_to_meet(spark, monkeypatch, ways, met, one_to_one):
    monkeypatch.setattr(J, "WAYS", ways)
    monkeypatch.setattr(J, "TILE", 7)
    left, right = numbered(1), numbered(2)
    df = lambda rows, name: spark.createDataFrame(rows, f"block string, {name} string").distinct()
    rows = J._meetings(df(left, "a"), df(right, "b"), 0.9).collect()
    assert {"tiles" if not r.need else "rests" if r.ways <= ways else "letters" for r in rows} == met
    assert {r.cut for r in rows if (r.m, r.n) == (11, 11)} == {7}
    got = [tuple(r) for r in J.fuzzy_match(df(left, "name"), df(right, "name"), "block", 0.9, one_to_one).collect()]
    assert sorted(got) == sorted(slow(left, right, 0.9, one_to_one))


@pytest.mark.parametrize("ways", [1000, 1])
def test_many_rows_a_name_are_not_broadcast(spark, monkeypatch, ways):
    monkeypatch.setattr(J, "WAYS", ways, raising=False)
    df = lambda rows, name: J.materialize(spark.createDataFrame([(g, n.upper()) for g, n in rows], f"block string, {name} string").distinct(), "names")
    found = J.similar_names(df(numbered(1), "a"), df(numbered(2), "b"), 0.9)
    assert found.count() == len(found.collect()) > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join [" in line and ("key#" in line or "letter#" in line)]
    assert joins and not any("Broadcast" in line for line in joins), plan
