"""Conversation repair, phrase mining and line quality against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers

from tallywright.llm import conversations, line_quality, lm_scoring, oracles, packing, phrases, queries, quotient

# ---- counting quotient filters


@settings(max_examples=60, deadline=None)
@given(
    st.integers(2, 4),
    st.sampled_from([9, 24, 40, 64]),
    st.integers(0, 5),
    st.lists(st.integers(0, 1 << 62), min_size=1, max_size=80),
)
def test_filters_lose_nothing(length, bits, block_bits, numbers):
    mask = (1 << bits) - 1
    words = [np.array([(n * (2 * i + 1)) & mask for n in numbers], np.uint64) for i in range(length)]
    entries = quotient.merge([(quotient.permute(words, bits), np.full(len(numbers), 200))])
    parts = [quotient.decode(data) for _, data in quotient.blocks(entries, bits, block_bits)]
    back, counts = quotient.merge(parts + parts)
    plain = Counter(zip(*(w.tolist() for w in words)))
    assert dict(zip(zip(*(w.tolist() for w in quotient.restore(back, bits))), counts.tolist())) == {
        gram: 400 * n for gram, n in plain.items()
    }


# ---- phrases


def _phrases(rows, least, share, top, longest):
    words, grams = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for k in range(1, longest + 1):
                for i in range(len(found) - k + 1):
                    key = (lang, tuple(found[i : i + k]))
                    grams[key] = grams.get(key, 0) + 1
    usual = {key: n for key, n in grams.items() if len(key[1]) > 1 and n >= least}
    out = []
    for lang in words:
        mine = []
        for (of, phrase), a in usual.items():
            if of != lang:
                continue
            cuts = [(grams[lang, phrase[:k]], grams[lang, phrase[k:]]) for k in range(1, len(phrase))]
            scores = [2_000_000 * a // (x + y) for x, y in cuts]
            at = scores.index(min(scores))
            holds = any(
                other == lang and len(longer) > len(phrase) and 100 * n >= share * a
                and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))
                for (other, longer), n in usual.items()
            )
            if not holds:
                mine.append((-scores[at], -a, " ".join(phrase).encode(), cuts[at]))
        for rank, (score, a, phrase, (x, y)) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, words[lang], -score))
    return sorted(out)


_TEXTS = [
    ("en", "Big red dog. big red dog, BIG RED DOG runs; big cat"),
    ("en", "big red dog runs\tbig  red\x0bdog runs! red dog runs big red dog runs"),
    ("en", None),
    ("en", ""),
    (None, "ébène É ébène É ébène É. ébène É"),
    ("und", "ébène É"),
    ("de", "a a a a a a a"),
    ("de", "a a a a a a a"),
    ("fr", "big red dog"),
]


@pytest.mark.parametrize("least, share, top, longest", [(2, 80, 4, 4), (1, 100, 100, 4), (2, 10, 3, 2), (3, 80, 9, 3)])
def test_phrases_against_a_plain_count(spark, least, share, top, longest):
    docs = spark.createDataFrame([(t, x, i, 0) for i, (x, t) in enumerate(_TEXTS)], "text string, lang string, rank int, n int")
    found = phrases.mine(docs.repartition(3), least=least, share=share, top=top, longest=longest)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == _phrases(_TEXTS, least, share, top, longest)


def test_phrases_of_an_empty_table_and_of_a_long_text(spark):
    schema = "text string, lang string"
    assert phrases.mine(spark.createDataFrame([], schema)).count() == 0
    row = ("red dog " * 20_000, "en")
    found = phrases.mine(spark.createDataFrame([row], schema), top=1).collect()
    assert list(map(tuple, found)) == _phrases([row[::-1]], 30, 80, 1, 4)


def test_filters_handed_on_in_between_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD_ENTRIES", 3)
    monkeypatch.setattr(phrases, "BLOCK_ENTRIES", 4)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 40)
    docs = spark.createDataFrame([(t, x) for x, t in _TEXTS], "text string, lang string")
    assert sorted(map(tuple, phrases.mine(docs, least=2).collect())) == _phrases(_TEXTS, 2, 80, 2000, 4)


def _against_sql(found, sql, sf_dir, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    wanted = con.execute(sql).df()[found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(wanted.itertuples(index=False, name=None))


def test_phrase_query_against_sql(spark, sf_dir):
    _against_sql(queries.op12_phrase_mining(spark, sf_dir), oracles.PHRASES, sf_dir, "documents")


def test_conversation_query_against_sql(spark, sf_dir):
    _against_sql(queries.op11_conversation_repair(spark, sf_dir), oracles.CONVERSATIONS, sf_dir, "conversations")


# ---- conversations


def _cheapest(rows):
    """(cost, audit, lines) by search in the order of cost, then of letters."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, roles, out = heapq.heappop(todo)
        state = roles[-1:] if roles[-1:] != "s" else "s"
        if i == len(rows) and (roles == "" or roles.endswith("a")):
            return cost, audit, list(out)
        if (i, state, bool(roles)) in done:
            continue
        done.add((i, state, bool(roles)))
        then = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[then]
        heapq.heappush(todo, (cost + 2, audit + "I", i, roles + then, (*out, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                first = role[:1]
                if first == then or (first == "s" and not roles):
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, roles + first, (*out, f"{role}:{text}")))
                heapq.heappush(todo, (cost + 2 + more, audit + "R", i + 1, roles + then, (*out, f"{name}:{text}")))


def _repaired(rows):
    """Plain version: rows of (conv_id, turn, role, text) -> result rows."""
    by_conversation: dict = {}
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = [" " if v is None else v for v in (role, text)]
        held = by_conversation.setdefault(conv, [])
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, held in by_conversation.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in held:
            stripped = text.rstrip(" \t\n\x0b\x0c\r")
            if not stripped:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("none" if stripped[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in held if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = zip(held, held[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, lines = _cheapest([(r, t, f) for (_, r, t), f in zip(held, faults)])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return out


def _made_rows(seed, conversations, longest):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No!", "why", " ", "", None, "Go on? ", "a\nb"]
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(int(rng.integers(1, longest))):
            turn = None if rng.random() < 0.05 else turn + int(rng.random() < 0.1)
            rows.append((conv, turn, roles[rng.integers(8)], texts[rng.integers(8)] if rng.random() < 0.6 else f"t{rng.integers(99)}."))
    return rows


_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_conversations_against_a_plain_search(spark):
    rows = _made_rows(1, 60, 14)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], _SCHEMA + ", cost int, part string")
    found = conversations.summary(conversations.repair(conversations.damaged(table.repartition(5))))
    assert _by_id(found.collect()) == _by_id(_repaired(rows))


@pytest.mark.parametrize("size", [1, 3, 7])
def test_long_conversations_are_spread_over_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "PIECE_ROWS", size)
    rows = _made_rows(2, 3, 9) + [(7, i, "user" if i % 3 else "assistant", f"t{i % 50}.") for i in range(200)]
    table = spark.createDataFrame(rows, _SCHEMA)
    repaired = conversations.repair(conversations.damaged(table))
    assert repaired.where("conv_id = 7").count() > 1
    assert _by_id(conversations.summary(repaired).collect()) == _by_id(_repaired(rows))


def test_divide_and_conquer_finds_the_least_audit():
    names = {1: "system", 2: "user", 3: "assistant", 0: "tool"}
    for length in range(5):
        for coded in itertools.product([0, 1, 2, 3, 6, 10, 9], repeat=length):
            rows = [(names[c & 3], "x", "blank" if c & 4 else "truncated" if c & 8 else "none") for c in coded]
            cost, audit, _ = _cheapest(rows)
            assert conversations._solved(bytes(coded)) == (cost, audit)


def test_odd_conversation_tables(spark):
    empty = spark.createDataFrame([], _SCHEMA)
    assert conversations.summary(conversations.repair(conversations.damaged(empty))).count() == 0
    rows = [(None, None, None, None)] * 5 + [(1, None, "user", "Hi " * 50_000 + ".")] * 4
    rows += [(c, 0, "user", "Hi.") for c in range(2, 60)]  # some conversations lose their only row
    found = conversations.summary(conversations.repair(conversations.damaged(spark.createDataFrame(rows, _SCHEMA))))
    wanted = _by_id(_repaired(rows))
    assert _by_id(found.collect()) == wanted
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in wanted)


# ---- line quality


def _brute_marginals(unary, chain):
    total, bad = 0.0, np.zeros(len(unary))
    for labels in itertools.product([0, 1], repeat=len(unary)):
        weight = np.exp(sum(u for u, y in zip(unary, labels) if y) + sum(chain[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        bad += weight * np.array(labels)
    return bad / total


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(5)
    sizes = [1, 6, 3, 1, 9]
    before = np.concatenate([[0], np.cumsum(sizes)])
    unary, chain = rng.normal(size=before[-1]) * 2, rng.normal(size=(2, 2))
    found, pairs, _ = line_quality.marginals(unary, before, chain)
    for a, b in zip(before[:-1], before[1:]):
        assert np.allclose(found[a:b], _brute_marginals(unary[a:b], chain))
    assert np.allclose(pairs.sum(axis=(1, 2)), 1)


def test_lines_are_those_of_split():
    texts = ["", "a", "a\n", "\n\n", None, "x\ny y y\nx", "é\n" * 3]
    content = "".join(t or "" for t in texts).encode()
    rows, before, size = line_quality.features(pa.array(texts))
    plain = [line.encode() for t in texts for line in (t or "").split("\n")]
    assert size.tolist() == [len(line) + 1 for line in plain] and len(rows) == len(plain)
    assert np.diff(before).tolist() == [len((t or "").split("\n")) for t in texts]
    again = [i for i in range(len(rows)) if rows[i, line_quality._KINDS + 5]]
    assert [plain[i] for i in again] == [b"x", "é".encode(), "é".encode()]
    y = plain.index(b"y y y")
    assert rows[y, line_quality._KINDS + 3] == pytest.approx(2 / 3) and content


def test_quality_is_learned_and_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op13_line_quality(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(found) == docs.count() and found["score"].between(0, 1).all()
    assert ((found["score"] >= 0.7) == (found["predicted"] == 1)).all()
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in found["doc_id"]]
    assert (found["held_out"] == held).all()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = found[found["held_out"]].merge(labels, on="doc_id")
    assert (both["predicted"] == both["quality"]).mean() > 0.95


def test_odd_rows_of_quality(spark):
    good, bad = "This is a plain line of text.\nAnd one more, as it goes.", "BUY!! NOW!! BUY!! NOW!!\n$$$ %%% $$$ %%%"
    rows = [(i, good if i % 2 else bad, i % 2, "s") for i in range(40)] + [(None, None, 1, "s"), (50, "", 0, None), (51, good, None, "s")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, score string")
    model = line_quality.fit(table, table)
    more = spark.createDataFrame([(1, good), (1, good), (2, bad), (3, None), (4, ""), (5, "x " * 200_000), (6, bad * 2000)], "doc_id bigint, text string")
    found = [r["score"] for r in line_quality.score(more, model).collect()]
    assert found[0] == found[1] > 0.7 > found[2] and found[3] == found[4]
    assert all(0 <= s <= 1 for s in found) and found[6] < 0.5
    kept = line_quality.score(table, model)
    assert kept.columns == ["doc_id", "text", "quality", "score", "predicted"] and kept.count() == len(rows)
    assert line_quality.score(table.limit(0), model).count() == 0
    assert line_quality.fit(table.limit(0), table) is None
    assert {r["score"] for r in line_quality.score(table, None).collect()} == {0.5}


# ---- packing: ids are those of the tokenizer


def _ids(encoder, texts):
    return [found[:-1].tolist() for found in encoder(pa.array(texts))]


def test_ids_of_every_letter_before_every_closing_mark():
    encoder = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
    for mark in ".,;:!?":
        words = [f"a{c}{mark}" for c in letters if ord(c) > 127]
        plain = encoder.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        wrong = [w for w, p, found in zip(words, plain, _ids(encoder, words)) if p.ids != found]
        assert not wrong
        encoder.known.clear()
        encoder.cores.clear()


def test_ids_of_random_texts_in_several_scripts():
    encoder = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    rng = random.Random(7)
    blocks = [(32, 127), (0xC0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x900, 0xA80), (0x1100, 0x1200), (0x4E00, 0x4F00), (0xAC00, 0xAD00)]
    made = []
    for _ in range(10_000):
        low, high = rng.choice(blocks)
        some = [chr(rng.randrange(low, high)) for _ in range(rng.randrange(1, 12))]
        made.append("".join(rng.choice(["", "", " ", ".", "!?", "\n", "\u0130", "\u0307"]) + c for c in some) + rng.choice(["", ".", "?!"]))
    made += ["TAT\u0130L\u0130.", "TAT\u0130L\u0130, ev", "\u0958.", "caf\u00e9!", "cafe\u0301!"]
    plain = encoder.tokenizer.encode_batch_fast(made, add_special_tokens=False)
    assert [p.ids for p in plain] == _ids(encoder, made)


def test_scores_against_plain_counts(spark):
    """Every column of a score, by plain Python over the same pieces."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["The cat the CAT\tsat", "a cat\nö sat  x" * 30, "", None, "q" * 40 + " zebra the", " \t ", "the the"]
    rows = [(i, t, i in (2, 4)) for i, t in enumerate(texts)] + [(None, "the end", False), (0, texts[0], False)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, held_out boolean").repartition(3)
    got = sorted(lm_scoring.score(docs, path, rounds=0).collect(), key=str)
    words = [(t or "").translate({c: c + 32 for c in range(65, 91)}).split() for _, t, _ in rows]
    counts = Counter(w for ws, (_, _, held) in zip(words, rows) if not held for w in ws)
    ends = sum(not held for _, _, held in rows)
    every, distinct = sum(counts.values()) + ends, len(counts) + 1
    pieces = lm_scoring.read_vocabulary(path)
    share = (ends + 1) / (every + 2)

    def log(w):
        return lm_scoring._Lattice([w.encode()], pieces).log_probability()[0] + np.log10(1 - share)

    def mixed(c, x):
        return np.log10((max(c - 0.75, 0) + (0.75 * distinct + 1) * 10**x) / (every + 1))

    want = []
    for (key, _, held), ws in zip(rows, words):
        base = sum(np.log10((counts[w] + 1) / (every + distinct + 1)) for w in ws)
        want.append((
            key, held, len(ws) + 1, sum(w in counts for w in ws) + 1, every,
            base + np.log10((ends + 1) / (every + distinct + 1)),
            sum(map(log, ws)) + np.log10(share),
            sum(mixed(counts[w], log(w)) for w in ws) + mixed(ends, np.log10(share)),
        ))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=lambda r: str(r[:5])), sorted(want, key=lambda r: str(r[:5]))):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])


def test_long_words_in_chunks(monkeypatch):
    pieces = lm_scoring.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    words = [
        "".join(rng.choice("theinformation0é漢") for _ in range(n)).encode() for n in (1, 7, 63, 64, 65, 300, 1000)
    ]
    words += [b"a" * 500, b"information" * 40]
    want = lm_scoring._Lattice(words, pieces).log_probability()
    monkeypatch.setattr(lm_scoring, "_CHUNKS", 3)
    for chunk in (5, 64):
        monkeypatch.setattr(lm_scoring, "_CHUNK", chunk)
        assert np.allclose([lm_scoring._long_log_probability(w, pieces) for w in words], want)


def test_words_weigh_by_their_counts():
    pieces = lm_scoring.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    words, weights = [b"cat", b"the", b"zebra"], np.array([5.0, 0.0, 2.0])
    got, total = lm_scoring._Lattice(words, pieces).expected(len(pieces.logs), weights)
    want = sum(w * lm_scoring._Lattice([x], pieces).expected(len(pieces.logs))[0] for x, w in zip(words, weights))
    assert np.allclose(got, want) and np.isclose(total, want.sum())


def test_groups_of_the_same_members_meet_once(spark):
    from tallywright.llm import ngram_join

    groups = {1: [5, 6, 7], 2: [5, 6], 3: [5, 6, 7], 4: [6, 7], 9: [5, 6, 7], 11: [5, 6]}
    rows = [(s, a, 10, a) for s, held in groups.items() for a in held]
    members = spark.createDataFrame(rows, "signature bigint, a bigint, n bigint, component bigint")
    kept = ngram_join._told_apart(members.repartition(5))
    assert sorted(kept.collect()) == [r for r in rows if r[0] in (1, 2, 4)]


def test_sketches_rule_out_sets_just_below_the_limit(spark):
    """Sets a little too far apart don't pass as pairs, in joins or in blocks; linked ones all do."""
    from pyspark.sql import functions as F

    from tallywright.llm import ngram_join

    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))

    def family(first, changed):
        return {
            first + i: np.sort(np.concatenate([base[rng.permutation(len(base))[changed:]], rng.integers(0, 1 << 63, changed).astype(np.uint64)]))
            for i in range(40)
        }

    sets = family(0, 28) | family(100, 14)  # alike by 0.76, and by more than 0.8
    rows = [(i, 7, len(x), i, ngram_join._sketch(x)) for i, x in sets.items()]
    members = spark.createDataFrame(rows, "a bigint, signature bigint, n bigint, component bigint, sketch binary")
    sized = members.join(ngram_join._sizes(members), "signature")
    met = {tuple(r) for r in ngram_join._meetings(ngram_join._dealt(sized, 16), 80).distinct().collect()}
    pairs = [(a, b) for a in sets for b in sets if a > b]
    sketches = members.select(F.col("a").alias("doc_id"), "n", "sketch")
    asked = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert {tuple(r) for r in ngram_join._plausible(asked, sketches, 80).collect()} == met
    alike = {p: len(np.intersect1d(sets[p[0]], sets[p[1]])) for p in pairs}
    alike = {p: both / (len(sets[p[0]]) + len(sets[p[1]]) - both) for p, both in alike.items()}
    linked = {p for p, share in alike.items() if share >= 0.8}
    far = {p for p, share in alike.items() if share < 0.775}
    assert len(linked) > 700 and len(far) > 700
    assert linked <= met and len(met & far) < len(far) / 20


def test_sketches_of_unlike_sizes_lose_no_link():
    from tallywright.llm import ngram_join

    rng = np.random.default_rng(9)
    for size in (1, 2, 5, 17, 33, 64, 65, 70, 257, 270, 1025, 1100):
        one = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for drop in range(0, len(one) // 5 + 1, max(1, len(one) // 40)):
            other = one[drop:]
            x, y = ngram_join._aligned([ngram_join._sketch(one), ngram_join._sketch(other)])
            assert np.bitwise_count(x ^ y).sum() <= drop
            linked = 100 * len(other) >= 80 * len(one)
            assert not linked or ngram_join._near(x, y, len(one), len(other), 80)


def test_python_meets_distinct_words_only(monkeypatch):
    """Letters are encoded once, whatever mark follows; ids are the tokenizer's own."""
    encoder = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    marks = ["", *'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', "...", "$$$", "###", "'", "',", "'s", "),", ".'", "--'"]
    words = [w + m for w in ("plain", "Plain", "üchü", "TATİLİ", "क़", "o'clock", "a-b", "x1", "1", "") for m in marks]
    texts = [" ".join(words), "\n".join(words[::-1]), None, "", "  plain  "]
    given, whole = [], encoder._encode

    def watched(some):
        given.extend(some)
        return whole(some)

    monkeypatch.setattr(encoder, "_encode", watched)
    found = _ids(encoder, texts)
    plain = encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert found == [p.ids for p in plain]
    assert not any(w in given for w in ("plain$", "plain$$$", "plain...", "Plain)", "üchü###"))
    before = len(given)
    assert _ids(encoder, texts) == found and len(given) == before
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    assert _ids(encoder, texts) == _ids(encoder, texts[::-1])[::-1] == found


def test_links_are_found_in_turns(spark, monkeypatch):
    """Signatures go before sketches meet, and no write shuffles all rows of a step."""
    from tallywright.llm import ngram_join

    rng = random.Random(4)
    rows = []
    for family in range(60):
        own = [f"w{i}" for i in range(60)]
        for at in rng.sample(range(5, 55), 6):
            own[at] = f"f{family}x{at}"
        rows += [(len(rows) + i, " ".join([*own, f"c{family}y{i}"])) for i in range(3)]
    rng.shuffle(rows)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    before, stored, there, writer = set(shared.iterdir()), Counter(), {}, type(table.write)

    def watched(self, path, *args, plain=writer.parquet, **more):
        plain(self, path, *args, **more)
        name, part = re.fullmatch(r"([a-z]+)-[0-9a-f]{32}/?(.*)", str(Path(path).relative_to(shared))).groups()
        stored[name, part] = spark.read.parquet(path).count()
        there[name] = {x.name.split("-")[0] for x in set(shared.iterdir()) - before}

    monkeypatch.setattr(writer, "parquet", watched)
    found = ngram_join.link(table, 3, 90, group_rows=8).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, i - i % 3) for i, _ in rows}
    for step in ("shared", "stars", "met"):
        parts = [n for (name, _), n in stored.items() if name == step]
        assert max(parts) <= 0.6 * sum(parts), (step, parts)
        assert step == "shared" or "signatures" not in there[step]
    assert {"shared", "spokes", "sets", "dealt"}.isdisjoint(there["rest"])


def test_links_keep_their_python_steps_in_stages_of_their_own(spark, monkeypatch):
    """Sets are made in one stage and compared in another, however few they are."""
    from tallywright.llm import ngram_join

    plans = []

    def settled(frame, name, batch=None):
        rows = frame.collect()
        plans.append(frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return spark.createDataFrame(rows, frame.schema)

    monkeypatch.setattr(ngram_join.tables, "settled", settled)
    texts = {1: "a b c d e f g h i j k", 2: "a b c d e f g h i j k l", 3: "x y z u v w"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "a bigint, b bigint")
    found = ngram_join._verified(pairs, docs, 3, 90)
    assert [tuple(r) for r in found.collect()] == [(2, 1)]
    assert "isFinalPlan=true" in plans[0] and "MapInArrow compare" in plans[0]
    assert "SortMergeJoin [b" in plans[0] and "BroadcastHashJoin [b" not in plans[0]


@pytest.mark.parametrize("step", ["sets", "languages"])
def test_workers_hold_a_small_slice_at_a_time(step):
    """What a Python worker holds beside a batch doesn't grow with the batch."""
    import tracemalloc
    from types import SimpleNamespace

    from tallywright.llm import language_id, ngram_join

    rng = random.Random(5)
    text = " ".join(f"word{rng.randrange(10**6)}" for _ in range(400))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1000), "text": [text] * 1000})
    docs = SimpleNamespace(mapInArrow=lambda run, schema: run, schema=SimpleNamespace(fields=[]))
    docs.drop = lambda *names: docs
    if step == "sets":
        run = ngram_join._fingerprinted(docs, 5, 80)
    else:
        cells = np.random.default_rng(6).random((2, 1 << language_id.BITS), np.float32)
        run = language_id.predict(docs, language_id.Model(["x", "y"], cells, cells[0], np.zeros((2, language_id.BANDS))))
    sum(b.num_rows for b in run([batch.slice(0, 1)]))  # what is kept between batches
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run([batch])) == 1000
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()
