"""Repeated strings whose surroundings share a beginning, or end within a context."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallywright.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string"


def _letters(r: random.Random, n: int, of: str = "abcdefghijklmnop") -> str:
    return "".join(r.choice(of) for _ in range(n))


def _brute_force(rows, length: int) -> list[tuple[int, bytes]]:
    """The first place of a string stays; rows of one key lose the same places."""
    raw = [(-1 if i is None else i, (text or "").encode()) for i, text in rows]
    places = sorted({(i, at, t[at : at + length]) for i, t in raw for at in range(len(t) - length + 1)})
    first, gone = {}, set()
    for i, at, string in places:
        if first.setdefault(string, (i, at)) != (i, at):
            gone.update((i, x) for x in range(at, at + length))
    return sorted((i, bytes(c for x, c in enumerate(t) if (i, x) not in gone)) for i, t in raw)


def _kept(spark, rows, **given) -> list[tuple[int, bytes]]:
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = suffix_dedup.deduplicate(docs, **given).collect()
    return sorted((-1 if x["doc_id"] is None else x["doc_id"], bytes(x["kept"])) for x in found)


@pytest.mark.parametrize("length, probe", [(100, 20), (30, 5), (12, 12), (13, 11)])
def test_repeats_that_end_anywhere_in_a_context(spark, length, probe):
    r = random.Random(length)
    passages = [_letters(r, 4 * length) for _ in range(3)] + [_letters(r, 3 * length, "ab"), "xyz" * length]
    rows = [(None, _letters(r, 50) + passages[0]), (3, None), (4, ""), (4, "")]
    for i in range(10, 34):
        text = ""
        for _ in range(4):
            p = r.choice(passages)
            start = r.randrange(len(p) - length)
            text += _letters(r, r.randint(0, length)) + p[start : start + r.randint(length - 2, 2 * length)]
        rows.append((i, text))
    rows += [rows[8], (9, rows[9][1]), (40, "é" * length + passages[1])]
    rows += [(41, passages[2] + "q" * length + passages[1]), (41, passages[1][: length + 7])]
    assert _kept(spark, rows, length=length, probe=probe) == _brute_force(rows, length)


def test_a_common_beginning_is_not_looked_up_string_by_string(spark, monkeypatch):
    looked_up, matches = [], suffix_dedup.matches

    def watched(suffixes, *given):
        looked_up.append(suffixes.count())
        return matches(suffixes, *given)

    monkeypatch.setattr(suffix_dedup, "matches", watched)
    r = random.Random(7)
    common = _letters(r, 30)
    rows = [(i, "".join(_letters(r, 70) + common for _ in range(20))) for i in range(40)]
    assert _kept(spark, rows) == sorted((i, t.encode()) for i, t in rows)
    strings = sum(len(t) - 99 for _, t in rows)
    assert sum(looked_up[1:]) < strings / 20
    assert looked_up[0] > strings / 81


def test_pieces_are_aligned_by_the_suffix_that_stands_for_them(spark):
    """What two texts share gives equal keys, and whole shared blocks equal contexts."""
    r = random.Random(5)
    shared = _letters(r, 300)
    rows = [(i, _letters(r, 10 + i) + shared + _letters(r, 10)) for i in range(2)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    firsts = suffix_dedup.sampled_suffixes(docs).collect()
    listed = []
    for x in firsts:
        place = ~x["place"] if x["place"] < 0 else x["place"]
        listed.append((x["doc_id"], place >> 30, (place >> 15) & 32767, place & 32767))
    assert all(0 < n <= off + 1 <= 81 for _, _, n, off in listed)
    open_rows = spark.createDataFrame(listed, "doc_id bigint, lo bigint, n int, off int")
    for width in (41, 9, 1):
        pieces = suffix_dedup._pieces(docs, open_rows, 100, 20, width).collect()
        covered = np.zeros((2, 400), int)
        keys = [set(), set()]
        for x in pieces:
            place = ~x["place"] if x["place"] < 0 else x["place"]
            lo, n = place >> 30, (place >> 15) & 32767
            assert 0 < n <= width
            covered[x["doc_id"], lo : lo + n] += 1
            if 10 + x["doc_id"] <= lo and lo + n + 99 <= 310 + x["doc_id"]:
                keys[x["doc_id"]].add((x["key"], lo - 10 - x["doc_id"]))
        for i, text in rows:
            strings = len(text) - 99
            assert (covered[i, :strings] == 1).all() and not covered[i, strings:].any()
        assert {k for k, _ in keys[0]} == {k for k, _ in keys[1]}
