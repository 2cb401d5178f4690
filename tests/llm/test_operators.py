"""The training-data operators against brute force, on small and odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywright.llm import (
    chunk_dedup,
    fingerprints,
    language_id,
    lm_scoring,
    mixing,
    nearest,
    ngram_join,
    packing,
    secret_scan,
    suffix_dedup,
)

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"


def _words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def _rows():
    base, other = _words(1, 300), _words(2, 80)
    near = base.replace(base.split()[100], "changed", 1)
    texts = [
        base, near, other + " " + base[200:900], base, None, "", "a", "... !!!", other,
        "Ünïcode ß 漢字 🙂 " * 40, _words(3, 20000), other + " token = 'abcDEF123456' " + other,
    ]
    return [
        (i, t, "en" if i % 2 else "de", None if i == 5 else f"s{i % 2}", 0, i) for i, t in enumerate(texts)
    ] + [(3, base, "en", "s1", 0, 3), (None, base, None, "s1", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_covers_every_token_once(docs, empty):
    tokenizer = Tokenizer.from_file(PATH)
    pieces = packing.pack(docs, PATH).toPandas()
    texts = sorted((t or "") for _, t, *_ in _rows())
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    assert pieces["length"].sum() == total
    known = {i: t or "" for i, t, *_ in _rows()}
    for row in pieces.dropna(subset=["doc_id"]).itertuples():
        ids = [*tokenizer.encode(known[row.doc_id], add_special_tokens=False).ids, 1]
        want = ids[row.start : row.start + row.length]
        assert np.frombuffer(row.ids, "<u4").tolist() == want and row.doc_tokens == len(ids)
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        assert part["length"].sum() <= 2048
    assert packing.pack(empty, PATH).count() == 0


def test_cuts_are_the_cheapest():
    r = random.Random(5)
    for _ in range(40):
        at = np.array([0, *sorted(r.sample(range(1, 60), 12))])
        at = at[np.concatenate([[True], np.diff(at) <= 16])] if (np.diff(at) <= 16).all() else np.arange(0, 60, 4)
        fee = np.array([r.randint(0, 5) for _ in at])

        def pay(a, b):
            n = int(at[b] - at[a])
            pad = 0 if n & (n - 1) == 0 else 16 - n
            return pad + int(fee[b]) + packing.SEQUENCE_COST if n <= 16 else float("inf")

        best = [0.0]
        for j in range(1, len(at)):
            best.append(min(best[i] + pay(i, j) for i in range(j)))
        cuts = packing.best_cuts(at, fee, 16)
        assert sum(pay(a, b) for a, b in zip(cuts, cuts[1:])) == best[-1]


def _base_spans(text: str) -> str:
    assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets(spark, empty):
    key = hashlib.sha256(b"x").hexdigest()
    r = random.Random(3)
    blob = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
    texts = [
        "secret=token:abcdef x", f"🙂 Token : '{key}' and {key}", "AKIA" + "Q7" * 8 + " AKIAAKIA", None, "",
        " ".join(f"api_key={i}abcdefg" for i in range(400)), f"see {blob} here", "antioninganingbleble is a word",
    ]
    rows = secret_scan.spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"))
    base = F.filter("spans", lambda x: x["kind"] != "random")
    got = rows.select("doc_id", secret_scan.listed(base).alias("base"), secret_scan.listed(F.col("spans")).alias("all"),
                      secret_scan.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    for row in got:
        assert row["base"] == _base_spans(texts[row["doc_id"]] or "")
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[6]["all"] == "random:4:52" and by_id[7]["all"] == ""
    assert by_id[6]["clean"] == "see [secret] here" and by_id[3]["clean"] is None
    assert secret_scan.spans(empty).count() == 0


def test_mixing_keeps_within_a_block(spark, empty):
    sizes = {"a": 1000, "b": 300, "c": 37, "": 5}
    rows = [(i * 7 + n, s or None) for n, s in enumerate(sizes) for i in range(sizes[s])]
    table = spark.createDataFrame(rows, "doc_id bigint, source string")
    shares = {"a": 5, "b": 3, "c": 1, "": 1}
    got = mixing.mix(table, shares, block_rows=4, buckets=8).toPandas()
    assert len(got) == len(rows) and got["mix_position"].is_unique
    blocks = got.fillna("").drop_duplicates(["source", "block"]).sort_values("block_slot")
    assert blocks["block_slot"].tolist() == list(range(len(blocks)))
    left = {s: -(-n // 4) for s, n in sizes.items()}
    fluid = lambda v: sum(min(n, shares[s] * v) for s, n in left.items())
    done = dict.fromkeys(sizes, 0)
    for slot, row in enumerate(blocks.itertuples(), 1):
        assert row.block == done[row.source]
        done[row.source] += 1
        low, high = 0.0, 1000.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if fluid(mid) < slot else (low, mid)
        for s in sizes:
            assert abs(done[s] - min(left[s], shares[s] * high)) < 1 + 1e-6
    assert mixing.mix(empty).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["turn", "place", "slot", "slots", "deadline", "stretch", "_rank", "_source", "_row", "_share", "a.b"]
    fields = ", ".join(f"`{n}` int" for n in names)
    rows = [(i, "x" if i % 3 else "y", *[i * 10 + k for k in range(len(names))]) for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, f"doc_id bigint, source string, {fields}"), block_rows=4)
    assert got.columns == ["doc_id", "source", *names, "block", "block_slot", "mix_position"]
    assert sorted(tuple(r)[: len(names) + 2] for r in got.collect()) == rows


def test_lattice_sums_all_segmentations():
    pieces = lm_scoring.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    logs = {}
    for size, (packed, numbers) in enumerate(zip(pieces.packed, pieces.numbers), 1):
        for p, i in zip(packed.tolist(), numbers.tolist()):
            logs[p.to_bytes(size)] = pieces.logs[i]

    def total(rest: bytes) -> float:
        if not rest:
            return 1.0
        return sum(
            np.exp(logs[rest[:k]]) * (1 - pieces.stop) * total(rest[k:])
            for k in range(1, 9)
            if rest[:k] in logs and k <= len(rest)
        )

    words = [b"the", b"entia", "éa".encode(), b"x", b"thingsthe"]
    got = lm_scoring._Lattice(words, pieces).log_probability()
    want = [np.log10(total(b" " + w) * pieces.stop / (1 - pieces.stop)) for w in words]
    assert np.allclose(got, want)


def test_lattice_has_the_long_pieces():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, logs = sentencepiece.SentencePieceProcessor(model_file=path), {}
    pieces = lm_scoring.read_vocabulary(path)
    names = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or b" " in raw[1:] or re.search(rb"[A-Z]", raw)):
            names.add(raw)
    logs = dict(zip(sorted(names, key=lambda p: (len(p), p)), pieces.logs))
    assert len(logs) == len(pieces.logs) and {b" function", b" information", b"translation"} <= set(logs)

    def total(word: bytes) -> float:
        sums = [1.0]
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[a] * np.exp(logs[word[a:end]]) * (1 - pieces.stop) for a in range(end) if word[a:end] in logs))
        return sums[-1]

    words = [b"function", b"information", b"translations", b"x", "préinformation".encode(), b"a" * 40]
    lattice = lm_scoring._Lattice(words, pieces)
    want = [np.log10(total(b" " + w) * pieces.stop / (1 - pieces.stop)) for w in words]
    assert np.allclose(lattice.log_probability(), want)
    uses, number = lattice.expected(len(pieces.logs))
    assert uses[list(logs).index(b" information")] > 0.9 and np.isclose(uses.sum(), number)


def test_scores_of_odd_texts(docs, empty):
    marked = docs.withColumn("held_out", language_id.held_out("doc_id", 7))
    got = lm_scoring.score(marked, public_tokenizers.path("piece_bpe_32k.model"), rounds=1).toPandas()
    assert len(got) == len(_rows()) and np.isfinite(got[["score", "base_score"]]).all().all()
    blank = got[got["doc_id"].isin([4, 5])]
    assert (blank["n_tokens"] == 1).all()
    assert lm_scoring.score(empty.withColumn("held_out", F.lit(False)), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_nearest_finds_copies_and_most_others(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)] + [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest.search(table, F.col("vec_id") % 20 == 0, k=5).toPandas()
    known = {i: np.array(v) for i, v in rows[:-3]}
    hits = total = 0
    for query, part in got.groupby("query_id"):
        best = sorted((-float(known[query] @ v), i) for i, v in known.items() if i != query)[:5]
        hits += len({i for _, i in best} & set(part["vec_id"]))
        total += 5
        assert sorted(part["rank"]) == [1, 2, 3, 4, 5]
    assert total == 5 * len([i for i in known if i % 20 == 0]) and hits >= 0.9 * total
    assert nearest.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_of_a_leaf_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(900)], "vec_id bigint, embedding array<double>")
    wanted = sorted(map(tuple, nearest.search(table, F.col("vec_id") % 2 == 0, k=5).collect()))
    largest, dealt = [], nearest._dealt

    def watched(placed, asked, rows):
        out = dealt(placed, asked, rows)
        largest.extend(x.groupBy("leaf", "block", "part").count().agg(F.max("count")).first()[0] for x in out)
        return out

    monkeypatch.setattr(nearest, "_dealt", watched)
    monkeypatch.setattr(nearest, "_BLOCK", 20)
    got = sorted(map(tuple, nearest.search(table, F.col("vec_id") % 2 == 0, k=5).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in wanted] and np.allclose([x[3] for x in got], [x[3] for x in wanted])
    assert len(largest) == 2 and max(largest) <= 50  # a leaf is visited by hundreds


def test_suffixes_against_brute_force(docs, empty):
    seen, want = {}, {}
    for i, text in sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in _rows()}):
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, int)
        for at in range(len(raw) - 99):
            if seen.setdefault(raw[at : at + 100], (i, at)) != (i, at):
                gone[at] += 1
                gone[at + 100] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        want[i] = bytes(np.frombuffer(raw, np.uint8)[~mask])
    for row in suffix_dedup.deduplicate(docs).collect():
        assert bytes(row["kept"]) == want[-1 if row["doc_id"] is None else row["doc_id"]]
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_family_merges_geometrically():
    family, keys = suffix_dedup.Family(), np.arange(8, dtype=np.uint64)
    for i in range(7):
        rows = np.zeros((8, 3), np.int64)
        assert not family.add(keys + np.uint64(100 * i), keys, rows).any()
    assert [rank for rank, *_ in family.levels] == [2, 1, 0]
    assert family.add(keys + np.uint64(300), keys, np.zeros((8, 3), np.int64)).all()


def test_fingerprints(spark, docs, empty):
    rank = fingerprints.rarity(docs)
    got = fingerprints.fingerprint(docs, rank).toPandas()
    same = got[got["text"] == _rows()[0][1]]["fingerprint"]
    assert len(same) == 4 and same.nunique() == 1
    assert fingerprints.compare(same.iloc[0], same.iloc[0]) == 1.0
    near = got[got["doc_id"] == 1]["fingerprint"].iloc[0]
    far = got[got["doc_id"] == 10]["fingerprint"].iloc[0]
    assert fingerprints.compare(same.iloc[0], near) > 0.7 > 0.3 > fingerprints.compare(same.iloc[0], far)
    follow = fingerprints.with_next(
        spark.createDataFrame([(i * i, str(i)) for i in range(50)], "doc_id bigint, text string"), ["text"], part_rows=3
    ).toPandas()
    assert len(follow) == 50
    for row in follow.itertuples():
        assert row.next_text == str((int(row.text) - 1) % 50)
    assert fingerprints.with_next(empty, ["text"]).count() == 0


def test_links_against_brute_force(docs, empty):
    for width, percent in ((5, 80), (3, 90)):
        sets = {}
        for i, text, *_ in _rows():
            w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower() if (text or "").isascii() else text)
            sets[-1 if i is None else i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        parent = {i: i for i in sets}

        def find(i):
            return i if parent[i] == i else find(parent[i])

        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        for row in ngram_join.link(docs, width, percent).collect():
            i = -1 if row["doc_id"] is None else row["doc_id"]
            assert row["n_shingles"] == len(sets[i])
            assert (-1 if row["component_id"] is None else row["component_id"]) == find(i)
    assert ngram_join.link(empty).count() == 0


def test_hot_groups_meet_in_blocks(spark, monkeypatch):
    """Many small components in one signature's group: bounded blocks, the same links."""
    rng, rows = random.Random(5), []
    base = _words(21, 60).split()
    for family in range(40):  # of one text; 2 to 4 copies each, the families apart
        own = list(base)
        for at in rng.sample(range(5, 55), 6):
            own[at] = f"f{family}x{at}"
        for copy in range(rng.randint(2, 4)):
            rows.append((len(rows), " ".join(own + [f"c{family}y{copy}"])))
    rng.shuffle(rows)
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in sets:
        for j in sets:
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert 20 < len({find(i) for i in sets}) < len(sets)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    largest, dealt = [], ngram_join._dealt

    def watched(sized, block_rows):
        out = dealt(sized, block_rows)
        largest.append(out.groupBy("signature").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ngram_join, "_dealt", watched)
    for crowd in (16, 1):  # also with a second signature
        monkeypatch.setattr(ngram_join, "_CROWD", crowd)
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(table, 3, 90, group_rows=8).collect()}
        assert got == {i: find(i) for i in sets}
    assert all(8 <= n <= 40 for n in largest)


def test_one_segment_of_linked_sets_agrees():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        bands = ngram_join.Bands(percent)
        for _ in range(300):
            size = int(rng.integers(1, 120))
            one = np.sort(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop = int(rng.integers(0, size * (100 - percent) // 100 + 1))
            other = np.sort(np.concatenate([one[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)]))
            both = len(np.intersect1d(one, other))
            if len(other) and 100 * both >= percent * (len(one) + len(other) - both):
                assert set(ngram_join._signatures(one, bands)) & set(ngram_join._signatures(other, bands))


def test_chunks_resist_shifts(spark, docs, empty):
    text = _words(11, 400)
    table = spark.createDataFrame([(1, text), (2, "inserted " + text), (3, _words(12, 60)), (4, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in chunk_dedup.repeats(table).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] == 0 and got[4]["n_bytes"] == 0
    assert got[2]["n_removed"] > 0.9 * len(text)
    assert chunk_dedup.repeats(docs).count() == len(_rows())
    assert chunk_dedup.repeats(empty).count() == 0


def test_languages(spark, docs, empty):
    rows = [(i, _words(i, 60).replace("a", "ñ") if i % 2 else _words(i, 60), "x" if i % 2 else "y") for i in range(200)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    odd = language_id.predict(docs, model).toPandas().set_index("extra")
    assert odd.loc[4, "lang_pred"] == odd.loc[7, "lang_pred"] == "und" and odd.loc[5, "rejected"]
    assert odd["score"].between(0, 1).all() and len(odd) == len(_rows())
    same = language_id.predict(spark.createDataFrame(rows, "doc_id bigint, text string, truth string"), model)
    assert same.where("lang_pred = truth").count() == 200
    assert language_id.predict(docs, language_id.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_key_remainders(spark):
    got = spark.range(50).select("id", language_id.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)
