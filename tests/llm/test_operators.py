"""Operators against brute force on a small corpus of awkward rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabwright.llm import brown, fingerprints, jaccard, mixing, packing, quality, sharding, substrings, textscan, toxicity, warczip
from tabwright.llm.queries import id_remainder, tokenizer_file

WORDS = [f"w{i}" for i in range(4000)]
SEP = re.compile(r"[^\x20\x09-\x0D]+")


def run_of(a, n):
    return " ".join(WORDS[a : a + n])


def words(text):
    return SEP.findall(text or "")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_scan_finds_words_and_tells_them_apart():
    texts = ["", " a  bb\n", None, "é\x0bü", "x" * 9, "x" * 10, "end"]
    w = textscan.scan(pa.array(texts))
    raw = w.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(w.start, w.end)] == [x for t in texts for x in words(t)]
    assert w.count.tolist() == [len(words(t)) for t in texts]
    assert len(set(textscan.word_hashes(w).tolist())) == 7


def test_shards_match_the_mixture(spark, corpus, nothing):
    found = rows_of(sharding.stratified_shards(corpus, 4))
    assert len(found) == corpus.count()
    sizes = collections.Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    hot = collections.Counter(r["shard"] for r in found if r["source"] == "hot")
    assert all(abs(n - 60 / 4) <= 2 for n in hot.values())  # a cut by rows may fall a row off on either side
    null = next(r for r in found if r["doc_id"] == 3)
    assert (null["size"], null["text_crc32"]) == (1, 0)
    assert sharding.stratified_shards(nothing, 4).count() == 0
    key = lambda rows: sorted(str((r["doc_id"], r["shard"], r["slot"])) for r in rows if r["doc_id"] != 6)
    assert key(found) == key(rows_of(sharding.stratified_shards(corpus.repartition(5), 4)))


def test_mix_reaches_its_targets(corpus, nothing):
    docs, served = mixing.fair_queue(corpus)
    docs, served = rows_of(docs), rows_of(served)
    taken = collections.Counter()
    for r in served:
        taken[r["row"]] += r["taken"]
    assert all(taken[d["row"]] <= 3 * d["size"] for d in docs)
    assert {d["id"]: d["size"] for d in docs}[9] == 14 * 1500
    total = sum(d["size"] for d in docs)
    for source in {d["source"] for d in docs}:
        own = [d for d in docs if d["source"] == source]
        target = own[0]["target"]
        assert target <= 3 * own[0]["source_size"] + 1e-9
        assert target - 1 <= sum(taken[d["row"]] for d in own) <= target + 1e-9
    assert sum({str(d["source"]): d["target"] for d in docs}.values()) == pytest.approx(total)
    assert mixing.fair_queue(nothing)[1].count() == 0


def test_first_words_cut_a_text(spark):
    df = spark.createDataFrame([("  a b\n c  d ", n) for n in range(1, 5)], "text string, n long")
    got = [r[0] for r in df.select(mixing.first_words("text", "n")).collect()]
    assert got == ["  a", "  a b", "  a b\n c", "  a b\n c  d"]


def test_base_counts_equal_brute_force(corpus):
    texts = [r["text"] for r in corpus.collect()]
    found = quality.base_counts(pa.array(texts))
    for i, text in enumerate(texts):
        w = words(text)
        assert found["n_words"][i] == len(w)
        assert found["word_chars"][i] == sum(map(len, w))
        assert found["n_symbols"][i] == sum(c in "#*$%&|<>" for c in text or "")
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert found["n_dup_lines"][i] == len(lines) - len(set(lines))
        windows = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        assert found["n_repeat_words"][i] == len(covered)


def labelled(spark, make, n=240):
    random.seed(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, make(bad), "en", "s", 0))
        labels.append((i, int(not bad), int(bad)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame([*labels, (None, 1, 0), (99999, None, None)], "doc_id long, quality int, toxic int"),
    )


def prose(bad, marker):
    w = [random.choice(["alpha", "beta", "gamma", "delta", "rho"]) + random.choice("abcdefgh") for _ in range(80)]
    if bad:
        for _ in range(6):
            w[random.randrange(80)] = marker()
    return " ".join(w)


def test_quality_model_learns_and_rules_hold(spark, corpus, nothing):
    docs, labels = labelled(spark, lambda bad: prose(bad, lambda: "###$$$%%%"))
    model = quality.train(docs, labels, sample=60)
    got = {r["doc_id"]: r for r in rows_of(quality.rate_documents(docs, model))}
    right = sum(got[i]["kept"] == (i % 3 != 0) for i in range(240))
    assert right > 225
    odd = rows_of(quality.rate_documents(corpus, model))
    assert len(odd) == corpus.count() and not any(r["kept"] for r in odd if r["base_failed"])
    assert quality.rate_documents(nothing, model).count() == 0
    untrained = quality.train(docs, labels.limit(0))
    assert {r["p_good"] for r in rows_of(quality.rate_documents(docs.limit(3), untrained))} == {0.5}


def test_toxicity_scores_held_out_texts(spark, corpus, nothing):
    docs, labels = labelled(spark, lambda bad: prose(bad, lambda: "vilest" + random.choice("abcdefghij")), 600)
    model = toxicity.train(docs, labels, where=id_remainder(3) != 1, sample=150)
    got = {r["doc_id"]: r["score"] for r in rows_of(toxicity.score_documents(docs, model))}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 3 == 0) for i in held]) > 0.95
    odd = rows_of(toxicity.score_documents(corpus, model))
    assert len(odd) == corpus.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_documents(nothing, model).count() == 0
    assert {r["score"] for r in rows_of(toxicity.score_documents(docs.limit(3), toxicity.train(docs, labels.limit(0))))} == {0.5}


def hamming(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_edited_fingerprints_follow_the_next_text(spark, corpus, nothing, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    docs = corpus.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in rows_of(fingerprints.edited_fingerprints(docs))}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(text, reverse=True)
    for i, following in zip(order, order[1:] + order[:1]):
        third = len(text[i]) // 3
        edited = text[i][: len(text[i]) - third] + text[following][:third]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(text[i])
        assert got[i]["near_next"] == 1 - hamming(got[i]["fingerprint"], got[following]["fingerprint"]) / 128
    assert got[0]["fingerprint"] == got[1]["fingerprint"]
    assert fingerprints.edited_fingerprints(corpus).count() == corpus.count()
    assert fingerprints.edited_fingerprints(nothing).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_block_tables_find_all_near_fingerprints(spark, radius):
    random.seed(radius)
    prints = [random.getrandbits(128) for _ in range(60)]
    for p in list(prints):
        for flips in (1, 3, 4, 6):
            q = p
            for b in random.sample(range(128), flips):
                q ^= 1 << b
            prints.append(q)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [((signed(p >> 64), signed(p & ((1 << 64) - 1))),) for p in prints + prints[:5]]
    df = spark.createDataFrame(rows, f"fingerprint {fingerprints.PRINT}")
    got = {(r["a"], r["b"]) for r in rows_of(fingerprints.near_pairs(df, radius))}
    names = sorted({f"{p:032x}" for p in prints})
    assert got == {(a, b) for a in names for b in names if a < b and hamming(a, b) <= radius}


def test_tokens_equal_the_tokenizer_and_pieces_cover_them(spark, corpus, nothing):
    from tokenizers import Tokenizer

    file = tokenizer_file()
    own = Tokenizer.from_file(file)
    own.encode_special_tokens = True
    odd = ["a  b", "it's  'll\n\n x", "<|endoftext|> y", "\x1c z", "　 日本", " ", "\n", "end \t"]
    texts = [r["text"] for r in corpus.collect()] + odd
    want = [own.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    ids, first = packing.token_ids(pa.array(texts), packing.encoder(packing.vocabulary(file)), packing.Known())
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want

    docs = corpus.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = rows_of(packing.pack_documents(docs, file))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for r in docs.collect():
        full, at = own.encode(r["text"] or "", add_special_tokens=False).ids + [1], 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(full)
            part = np.array(full[at : at + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(full)
    for own_pieces in by_sequence.values():
        at = 0
        for p in sorted(own_pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack_documents(nothing, file).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def cut_by_hand(docs):
    smallest = {}
    for i, text in docs:
        w = words(text)
        for j in range(len(w) - 12) if i is not None else ():
            key = tuple(w[j : j + 13])
            smallest[key] = min(i, smallest.get(key, i))
    out = []
    for i, text in docs:
        w = words(text)
        gone = {j + k for j in range(len(w) - 12) if i is not None and smallest[tuple(w[j : j + 13])] < i for k in range(13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("frequent", [(256, 4096), (2, 3)])
def test_substrings_equal_brute_force(corpus, nothing, monkeypatch, frequent):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    got = substrings.deduplicated(corpus.repartition(6)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    want = cut_by_hand([(r["doc_id"], r["text"]) for r in corpus.collect()])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert substrings.deduplicated(nothing).count() == 0


def shingles(text):
    w = words(text)
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups_by_hand(rows):
    """Sorted (doc_id, class_id, copy_of, n_links, keeper) of rows of (doc_id, text, text_hash)."""
    sets = [shingles(t) if i is not None else set() for i, t, _ in rows]
    near = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    links = [[b for b in range(len(rows)) if b != a and near(a, b)] for a in range(len(rows))]
    group = list(range(len(rows)))
    while True:
        least = [min([group[a], *(group[b] for b in links[a])]) for a in range(len(rows))]
        if least == group:
            break
        group = least
    out = []
    for a, (i, _, h) in enumerate(rows):
        if not sets[a]:
            out.append((i, i, i, 0, True))
            continue
        own = [b for b in range(len(rows)) if group[b] == group[a]]
        first = min((rows[b][0], rows[b][2]) for b in own)
        same = min(rows[b][0] for b in own if sets[b] == sets[a])
        out.append((i, first[0], same, len(links[a]), first == (i, h)))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [2048, 4])
def test_jaccard_join_equals_brute_force(spark, corpus, nothing, tile):
    docs = corpus.select("doc_id", "text")
    more = [(6, run_of(600, 200)), (6, run_of(3300, 200)), (15, run_of(600, 199) + " x"), (50, run_of(3300, 198) + " y z"), (6, run_of(600, 200)), (0, None), (None, run_of(600, 200))]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(4)
    rows = [tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()]
    found = jaccard.near_rows(docs, tile=tile).select("doc_id", "class_id", "copy_of", "n_links", "keeper")
    assert sorted(map(tuple, found.collect()), key=str) == groups_by_hand(rows)
    assert jaccard.near_groups(corpus).count() == corpus.count()
    assert jaccard.near_groups(nothing).count() == 0


def test_jaccard_join_of_one_id_with_many_texts(spark):
    """Every row has one of two ids; each text has a partner under the other id or its own."""
    rows = []
    for i in range(40):
        text = [f"t{i}x{j}" for j in range(120)]
        rows += [(i % 2, " ".join(text)), (1, " ".join(text[:118]) + " a b"), (0, " ".join([f"u{i}x{j}" for j in range(30)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_rows(docs).collect()
    assert sorted(r["n_links"] for r in got) == [0] * 40 + [1] * 80
    assert sum(r["keeper"] for r in got) == 80


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 40)] + [(139, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in rows_of(jaccard.components(spark.createDataFrame(edges, "u long, v long")))}
    assert got == {**{i: 0 for i in range(1, 21)}, **{100 + i: 100 for i in range(1, 40)}, 500: 100}


def test_runs_reach_the_recall():
    runs = jaccard.runs_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**jaccard.DEPTH) ** runs >= 0.9999 > 1 - (1 - 0.8**jaccard.DEPTH) ** (runs - 1)


def test_language_model_base_equals_brute_force(spark, corpus, nothing):
    got = {r["doc_id"]: r for r in rows_of(brown.score_documents(corpus.filter("doc_id <> 6"), id_remainder(10) != 0))}
    docs = [(r["doc_id"], r["text"]) for r in corpus.filter("doc_id <> 6").collect()]
    fold = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + [None]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    seen = collections.Counter(w for i, t in docs if not held[i] for w in fold(t))
    total = sum(seen.values())
    for i, text in docs:
        tokens = fold(text)
        base = sum(np.log10((seen[w] + 0.1) / (total + 0.1 * (len(seen) + 1))) for w in tokens)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(seen[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert brown.score_documents(nothing, id_remainder(10) != 0).count() == 0


def test_exchange_puts_alternating_words_apart():
    bigrams = np.zeros((9, 9))
    bigrams[:4, 4:8] = 50
    bigrams[4:8, :4] = 50
    of = brown.exchange(bigrams, classes=2)
    assert len(set(of[:4])) == len(set(of[4:8])) == 1 and of[0] != of[4] and of[8] == 2


def test_zip_members_in_both_formats(tmp_path):
    import pyarrow.fs as fs
    import zipfile

    for zip64 in (False, True):
        path = tmp_path / f"{zip64}.zip"
        path.write_bytes(warczip.zip_bytes([("a/b", b"x" * 1000), ("c", b"")], zip64))
        assert zipfile.ZipFile(path).read("a/b") == b"x" * 1000 and zipfile.ZipFile(path).testzip() is None
        with fs.LocalFileSystem().open_input_file(str(path)) as f:
            places = warczip.members(f, path.stat().st_size)
            at, size, deflated = places["a/b"]
            assert f.read_at(size, at) == b"x" * 1000 and places["c"].size == 0 and not deflated


def package(path, members):
    """A ZIP file of (name, bytes, whether to deflate)."""
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for name, data, deflate in members:
            z.writestr(name, data, zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED)
    return f"file://{path}"


def test_packages_of_other_writers(spark, tmp_path):
    import gzip
    import json

    def archive(name, ids, key=""):
        data, lines = b"", []
        for i in ids:
            raw = gzip.compress(warczip.record_bytes(i, f"http://x/{i}", i.encode() * 9, None, "2026-01-01T00:00:00Z"))
            lines.append(key + json.dumps({"offset": str(len(data)), "length": str(len(raw)), "filename": name}))
            data += raw
        return (f"archive/{name}", data, False), "\n".join(lines) + "\n"

    def read(name, members):
        path = package(tmp_path / f"{name}.wacz", members)
        archives = spark.createDataFrame([(path, 1, 1)], warczip.ARCHIVES)
        return {r["record_id"]: bytes(r["payload"]) for r in warczip.read_archives(archives, payloads=True).collect()}

    one, first = archive("a.warc.gz", ["1", "2"], "com,x)/ 20260101000000 ")
    two, second = archive("b.warc.gz", ["3"])
    want = {i: i.encode() * 9 for i in "123"}
    assert read("two", [one, two, ("indexes/index.cdxj", first + second, False)]) == want
    assert read("both", [one, two, ("indexes/a.cdxj", first, True), ("indexes/b.cdx.gz", gzip.compress(second.encode()), False), ("pages/pages.jsonl", "{}", True)]) == want
    bare = "".join(json.dumps({k: v for k, v in json.loads(line[line.index("{") :]).items() if k != "filename"}) + "\n" for line in first.splitlines())
    assert set(read("bare", [one, ("indexes/index.cdx", bare, False)])) == {"1", "2"}
    for name, members, what in [
        ("deflated", [(one[0], one[1], True), ("indexes/index.cdxj", first, False)], "deflated"),
        ("unlisted", [one, two, ("indexes/index.cdxj", first, False)], "in no index"),
        ("missing", [one, ("indexes/index.cdxj", first + second, False)], "isn't there"),
        ("plain", [one], "no index"),
    ]:
        with pytest.raises(Exception, match=what):
            read(name, members)


def test_a_task_for_each_archive(spark):
    pages = spark.range(64).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 100 + id) AS html").repartition(4)
    archives = warczip.write_archives(warczip.with_roles(pages), f"file://{warczip.scratch_path(spark, 'test')}", archive_bytes=1500)
    n = archives.count()
    assert n > 4 and warczip.read_archives(archives).rdd.getNumPartitions() == n


def test_pages_survive_the_round_trip(spark):
    pages = [(i, f"http://x/{i}?q=ü\n", h, "k") for i, h in enumerate(["<p>é</p>", None, "", "<p>é</p>", "a" * 300_000, "a\r\n\r\nb"])]
    pages += [(0, None, "<p>é</p>", "again"), (None, "u", "null id", "k")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, id string")
    back = rows_of(warczip.archive_round_trip(df))
    got = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in back)

    def want(i, html):
        raw = (html or "").encode()
        first = min((p[0] for p in pages if (p[2] or "").encode() == raw and p[0] is not None), default=None)
        kind = "response" if first is None or first == i else "revisit"
        return (str(i), kind, str(first) if kind == "revisit" else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())

    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted((want(p[0], p[2]) for p in pages), key=key)
    assert {r["url"] for r in back if r["record_id"] == "4"} == {"http://x/4?q=ü\n"}
    small = {r["record_id"]: r["record_type"] for r in rows_of(warczip.archive_round_trip(df.filter("page_id > 0"), least=1))}
    assert small["1"] == small["2"] == "response"
    assert warczip.archive_round_trip(df.limit(0)).count() == 0
