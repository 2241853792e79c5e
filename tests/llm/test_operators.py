"""Each operator against a brute-force version, on the smallest tables and on rows made to be awkward."""

from __future__ import annotations

import collections
import gzip
import hashlib
import math
import zlib

import numpy as np
import pytest

from triplane.llm import components, decontam, katz, langid, license_scan, mixing, ngram_join, qda, quality_rules, queries, substring_dedup, warc
from triplane.llm.common import Scratch, packed, unpacked

RNG = np.random.default_rng(5)
WORDS = np.array([a + b for a in "b c d f g h l m n p r s t".split() for b in "an en in on un ar er or al el ast est ing".split()])


def prose(n: int) -> list[str]:
    return RNG.choice(WORDS, n).tolist()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def rows() -> list[tuple[int | None, str | None]]:
    """Near and exact copies, shared passages, short, empty, null, repetitive and very long texts, repeated rows."""
    base, passage = prose(120), prose(60)
    out: list[tuple[int | None, str | None]] = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:60], "zzz", *base[60:]])), (4, " ".join(base[1:]))]
    out += [(10 + i, " ".join(prose(30) + passage + prose(25))) for i in range(4)]
    out += [(20, None), (21, ""), (22, " \t\n"), (23, "one"), (24, "One two"), (25, "ONE two"), (26, "one two three"), (27, "a " * 400), (28, "x" * 500), (29, "éß " * 90)]
    out += [(30, " ".join(prose(20_000))), (31, "\n".join(["same line here now"] * 9)), (32, " ".join(prose(60)) + "\n" + " ".join(passage))]
    for k in range(12):  # light sets: about 20 words, one changed
        short = list(base[:21])
        short[k] = f"w{k}"
        out.append((40 + k, " ".join(short)))
    out += [(None, " ".join(base)), (1, " ".join(base))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    made = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], "doc_id long, text string, node int, score int, blob int, component_id string")
    return made.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def shingle_set(text: str | None, k: int) -> frozenset:
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, num, den, k):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids) if ids else key))
    return sorted(out, key=str)


@pytest.mark.parametrize(("num", "k", "light", "block"), [(90, 3, None, 2000), (90, 3, 0, 3), (80, 5, 64, 2000), (80, 5, 5, 4)])
def test_jaccard_components(docs, rows, num, k, light, block):
    found = ngram_join.jaccard_components(docs, num, 100, k, light=light, block_sets=block)
    assert sorted(map(tuple, found.collect()), key=str) == brute_components(rows, num, 100, k)


def test_jaccard_blocks_are_dealt(spark):
    """A cluster's blocks don't lie in one task, and what is one component is not compared again."""
    rng = np.random.default_rng(2)
    base = np.sort(rng.integers(1, 2**63, 200, dtype=np.uint64))
    made = [(i, 200, base.tobytes()) for i in range(40)] + [(100, 200, np.sort(np.append(base[10:], rng.integers(1, 2**63, 10, dtype=np.uint64))).tobytes()), (200, 50, np.sort(rng.integers(1, 2**63, 50, dtype=np.uint64)).tobytes())]
    sets = spark.createDataFrame(made, "node long, n_shingles long, members binary")
    t = ngram_join.Threshold(90, 100)
    groups = sets.selectExpr("node", "members", "node % 1 AS cluster", "node % 8 AS block")
    plan = ngram_join._scanned(groups.repartition("cluster"), t, "cluster", "block")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cluster" in plan and "block" in plan.split("hashpartitioning(", 1)[1].split(")")[0]
    with Scratch(spark) as keep:
        clusters = sets.selectExpr("node", "1L AS cluster")
        links = ngram_join.verified_links(keep.stored(sets), clusters, t, 5, 1 << 20, keep).collect()
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(found) == {*range(40), 100} and set(found.values()) == {0} and len(links) < 60


def test_jaccard_sizes():
    """Any two sets that link share a bucket: sizes and overlaps at the limit."""
    t = ngram_join.Threshold(90, 100)
    rng = np.random.default_rng(1)
    for n in [1, 5, 9, 10, 19, 20, 38, 57, 100, 333, 1000]:
        for m in {n, t.partners(n)[-1]}:
            need = t.overlap(n, m)
            if need > n:
                continue
            pool = rng.integers(1, 2**63, n + m, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:need], pool[n : n + m - need]]))
            common = min(t.common(n), t.common(m))
            first = [set(x[: t.prefix(len(x), t.common(len(x)))].tolist()) for x in (a, b)]
            assert len(first[0] & first[1]) >= common >= max(t.needed(n), 1) * (n == m)
            assert len(first[0] & first[1]) >= max(t.needed(n), t.needed(m))
            if n <= 30:
                keys = [{k for ks, _, _ in ngram_join.light_keys(t, x, 64) for k in ks.tolist()} for x in (a, b)]
                assert keys[0] & keys[1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (11, 11), (None, 3), (20, 21), (21, 22), (22, 20)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 4, 20: 20, 21: 20, 22: 20}


def brute_dedup(rows, length):
    seen, out = set(), {}
    for key, text in sorted({r for r in rows if r[0] is not None}):
        raw = (text or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                cover[i : i + length] = 1
            seen.add(raw[i : i + length])
        cut = np.diff(np.concatenate([[0], cover]))
        out[key] = (len(raw), int(cover.sum()), int((cut == 1).sum()), hashlib.sha256(bytes(b for b, c in zip(raw, cover, strict=False) if not c)).hexdigest())
    return out


@pytest.mark.parametrize(("length", "trigger", "max_group"), [(100, 32, 50_000), (100, 32, 1), (40, 8, 50_000)])
def test_substring_dedup(docs, rows, length, trigger, max_group):
    found = substring_dedup.dedup(docs, length=length, trigger=trigger, max_group=max_group, with_text=True, carry=("blob", "node"))
    want = brute_dedup(rows, length)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
            assert r.carried.blob == 3


def test_decontamination(spark, docs, rows):
    base = dict(r for r in rows if r[0] is not None)
    source = words(base[10])
    items = [(1, b" ".join(source[32:72]).decode().upper()), (2, b" ".join(source[40:47]).decode()), (3, " ".join(prose(30))), (4, None), (5, ""), (6, "one two three"), (7, " ".join(prose(10)) + " " + b" ".join(source[30:90]).decode()), (1, " ".join(prose(12)))]
    items.append((8, base[30][5000:5400]))
    got = decontam.contaminated(docs, spark.createDataFrame(items, "item_id int, text string"))
    want = []
    for key, text in rows:
        for item, body in items:
            a, b = shingle_set(body, 5), shingle_set(text, 5)
            if a and len(a & b) >= 0.8 * len(a):
                want.append((key, item, len(a & b), len(a & b) / len(a)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r[1] for r in want} >= {1, 2, 6, 7, 8}
    kept = decontam.decontaminated(docs, spark.createDataFrame(items, "item_id int, text string"))
    hit = {r[0] for r in want}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(k for k, _ in rows if k is not None and k not in hit)
    assert kept.columns == docs.columns


def brute_katz(taught, order):
    """P(word, history) and the counts, by dictionaries."""
    streams = [[b"^"] * (order - 1) + words(t) + [b"$"] for t in taught]
    body = [list(range(order - 1, len(s))) for s in streams]
    c = collections.Counter(s[i] for s, at in zip(streams, body, strict=True) for i in at)
    grams = {n: collections.Counter(tuple(s[i - n + 1 : i + 1]) for s, at in zip(streams, body, strict=True) for i in at) for n in range(2, order + 1)}
    total, kinds = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.1) / (total + 0.1 * (kinds + 1))
    sums = {}
    d = {}
    for n, counts in grams.items():
        of = collections.Counter(counts.values())
        d[n] = katz.discounts(np.array([of[i] if i else 0 for i in range(7)], float))

    def star(n, r):
        return (d[n][r] if r <= 5 else 1) * r

    def prob(h, w):
        if not h:
            return p(w)
        n = len(h) + 1
        after, mass, low = sums[n].get(h, (0, 0, 0))
        if not after:
            return prob(h[1:], w)
        m, r = mass / after, grams[n][(*h, w)]
        g = min(1.0, after / (after + 1) / m)
        return g * star(n, r) / after if r else (1 - g * m) / (1 - low) * prob(h[1:], w)

    for n in grams:
        sums[n] = {}
        for g, r in grams[n].items():
            x = sums[n].get(g[:-1], (0, 0.0, 0.0))
            sums[n][g[:-1]] = (x[0] + r, x[1] + star(n, r), x[2] + prob(g[1:-1], g[-1]))
    return p, prob, c, total


@pytest.mark.parametrize(("share", "bucket", "order", "chunk"), [(500_000, 1_000_000, 3, 1 << 20), (4, 700, 3, 5000), (3, 900, 2, 5000), (9, 5000, 4, 30_000)])
def test_katz(spark, docs, rows, share, bucket, order, chunk, monkeypatch):
    monkeypatch.setattr(katz, "SHARE", share)
    monkeypatch.setattr(katz, "BUCKET", bucket)
    from pyspark.sql import functions as F

    got = katz.score_documents(docs, F.col("doc_id") % 3 != 0, order=order, chunk_bytes=chunk).collect()
    p, prob, c, total = brute_katz([t for k, t in rows if k is not None and k % 3], order)
    assert len(got) == len(rows)
    text = dict(rows)
    histories = set()
    for r in got:
        s = [b"^"] * (order - 1) + words(text[r.doc_id]) + [b"$"]
        own = range(order - 1, len(s))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[s[i]] > 0 for i in own), total)
        assert r.base_score == pytest.approx(sum(math.log10(p(s[i])) for i in own), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(prob(tuple(s[i - order + 1 : i]), s[i])) for i in own), rel=1e-9)
        histories.add(tuple(s[:order - 1]))
        histories.add(tuple(s[-order:-1]))
    for h in histories:
        assert sum(prob(h, w) for w in c) + prob(h, None) == pytest.approx(1)


def test_katz_model(spark, docs, rows):
    """A fitted model scores another corpus."""
    from pyspark.sql import functions as F

    with Scratch(spark) as keep:
        model = katz.fit(docs.where(F.col("doc_id") % 3 != 0), keep)
        assert [t.count() > 0 for t in model.tables] == [True, True]
        other = katz.score(docs.where(F.col("doc_id") % 3 == 0), model).collect()
    together = {r.doc_id: r for r in katz.score_documents(docs, F.col("doc_id") % 3 != 0).collect()}
    assert len(other) == sum(k is not None and k % 3 == 0 for k, _ in rows)
    for r in other:
        want = together[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want.n_tokens, want.n_known, want.train_tokens)
        assert (r.base_score, r.score) == (pytest.approx(want.base_score), pytest.approx(want.score))


def test_katz_long_text():
    data = np.frombuffer((" ".join(prose(3000)) + "x" * 5000 + " end").encode(), np.uint8)
    offsets = np.array([0, 7000, 7000, len(data)])
    a, b = katz._hashes(data, offsets), katz._hashes(data, offsets, 100)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_quality_rules(docs, rows):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        raw = text[r.doc_id] or ""
        w = raw.encode().split()
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [x for x in raw.encode().split(b"\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(len(x.decode()) for x in w), sum(map(raw.count, "#*$%&|<>")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and kept[10] and kept[30] and not kept[27] and not kept[28]
    junk = RNG.integers(33, 126, 20_000, dtype=np.uint8).tobytes().decode()
    texts = {"noise": quality_rules.statistics, "bad": None}
    assert texts
    s = next(iter(quality_rules.statistics(np.frombuffer((" ".join(junk[i : i + 9] for i in range(0, 20_000, 9))).encode(), np.uint8), np.array([0, 20_000 + 20_000 // 9]))))
    assert not quality_rules.judged(s, quality_rules.Bands())["kept"][0]


def test_quality_classifier(spark, docs, rows):
    good = [(1000 + i, " ".join(prose(int(RNG.integers(60, 300)))) + ".") for i in range(60)]
    bad = [(2000 + i, " ".join(x.upper() + "!!" for x in prose(int(RNG.integers(60, 300))))) for i in range(60)]
    more = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 2000)) for k, _ in good + bad if k % 3] + [(None, 1), (1001, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in qda.classify(more, labels).collect()}
    assert all(got[k].predicted == (k < 2000) for k, _ in good + bad)
    odd = qda.classify(docs, labels.where("false")).collect()
    assert len(odd) == len(rows) and {r.score for r in odd} == {0.5}
    model = qda.fit(more, labels)
    scored = qda.classify(docs, labels)
    assert scored.count() == 0 or all(0 <= r.score <= 1 for r in scored.collect())
    assert model.labels == (0, 1)
    one = qda.fit(more, labels.where("quality = 1"))
    assert one.score(np.zeros((1, 13))).tolist() == [1.0]


def test_language(spark, docs, rows, sf_dir):
    taught = queries.table(spark, sf_dir, "documents")
    profiles = langid.learn(taught)
    assert profiles.langs == ("de", "en", "es", "fr")
    got = docs.select("doc_id", "text", langid.predicted_language(profiles).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.p.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
        assert 0 <= r.p.score <= 1
    assert {r.p.lang_pred for r in docs.select(langid.predicted_language(langid.learn(taught.where("false"))).alias("p")).collect()} == {"und"}
    found = queries.op3_language_id(spark, sf_dir).join(taught.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r.lang_pred for r in found) >= 0.95 * len(found)


PAGES = [
    (1, "u", "<p>" + "abc " * 50), (2, "u", "<p>" + "abc " * 50), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "short"), (6, "u", "short"),
    (7, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (8, "u", "\r\n\r\n" * 300), (9, "u", "é漢" * 40_000), (10, "u", "\r\n\r"), (11, "u", "x" * 99), (12, "u", "x" * 99), (13, "u", "x" * 100), (14, "u", "x" * 100),
    (0, "u", "<p>" + "abc " * 50), (5, "u", "short"), (None, "u", "lost"),
]


@pytest.mark.parametrize(("segment_bytes", "chunk_bytes"), [(16 << 10, 4 << 10), (64, 7)])
def test_warc(spark, segment_bytes, chunk_bytes):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, record int").repartition(4)
    got = {r.page_id: r for r in warc.round_trip(pages, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes).collect()}
    want = {p: (h or "").encode() for p, _, h in PAGES if p is not None}
    assert set(got) == set(want)
    first: dict[bytes, int] = {}
    for p in sorted(want):
        first.setdefault(want[p], p)
    for p, raw in want.items():
        refers = first[raw] if len(raw) >= 100 and first[raw] != p else None
        assert (got[p].payload_bytes, got[p].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[p].record_type, got[p].refers_to) == ("revisit" if refers is not None else "response", refers)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_faults(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 5000)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "a"), segment_bytes=500)
    rows = warc.read_records(spark, str(tmp_path / "a"))
    assert rows.where("kind = 'continuation'").count() > 5
    head = bytes(rows.where("segment = 1").first().block)
    assert head.startswith(b"HTTP/1.1 200 OK")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a").glob("*.gz"))
    for field in (b"WARC-Date: 2", b"Content-Type: application/http; msgtype=response", b"WARC-Segment-Total-Length: "):
        assert field in raw
    twice = spark.createDataFrame([(1, "u", "y" * 500), (2, "u", "y" * 500)], "page_id long, url string, html string")
    warc.write(twice, str(tmp_path / "b"), date="2020-01-01T00:00:00Z")
    with Scratch(spark) as keep:
        found = {r.record: r for r in warc.read(warc.read_records(spark, str(tmp_path / "b")), keep).collect()}
    assert (found["2"].payload_bytes, found["2"].refers_to) == (500, "1")
    for p in (tmp_path / "b").glob("*.gz"):  # a revisit whose response is not there
        text = gzip.decompress(p.read_bytes()).replace(b"WARC-Refers-To: <urn:x-page:1>", b"WARC-Refers-To: <urn:x-page:9>")
        p.write_bytes(gzip.compress(text))
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="nothing to revisit"), Scratch(spark) as keep:
        warc.read(warc.read_records(spark, str(tmp_path / "b")), keep).collect()
    with pytest.raises(Exception, match="segments missing"):
        warc.whole_blocks(rows.where("segment <> 3")).collect()
    for body in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(body)
    assert warc.dechunked(warc.chunked(b"\r\n\r\n" * 9, 5)) == b"\r\n\r\n" * 9


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        (1, "a/LICENSE", f"Text.\n{mit}"), (2, "a/b/c.txt", "no statement"), (3, "a/b/d/COPYING.md", gpl), (4, "a/b/d/e.c", None), (5, "a/b/d/f.c", f"x\n{mit}"), (6, "z/q.c", "see the license of your car"),
        (7, None, gpl), (8, None, ""), (9, "top.txt", "x"), (2, "a/b/c.txt", "no statement"), (None, "a/b/g.txt", "x"), (10, "a/b/d/h/i/j.c", "Licensing terms vary. Ask."), (11, "LICENSE", "We LICENSE under CC BY-NC 4.0. Thanks."),
    ]
    made = spark.createDataFrame([(*f, 1) for f in files], "doc_id long, path string, text string, licence int")
    got = {r.doc_id: (r.licence, r.basis) for r in license_scan.scan(made).collect()}
    assert len(got) == 12
    assert got[1] == ("MIT", "own") and got[2] == ("MIT", "inherited") and got[3] == ("GPL-3.0", "own")
    assert got[4] == ("GPL-3.0", "inherited") and got[5] == ("MIT", "own") and got[10] == ("GPL-3.0", "inherited")
    assert got[7] == ("GPL-3.0", "own") and got[8] == (None, "none") and got[None] == ("MIT", "inherited")
    assert got[11] == ("CC-BY-NC-4.0", "own") and got[9] == ("CC-BY-NC-4.0", "inherited") and got[6] == ("CC-BY-NC-4.0", "inherited")
    assert license_scan.scan(made.where("false")).count() == 0


def test_statements_that_can_match(spark):
    """The choice of statements loses none that reaches the limit, whatever words it has."""
    from pyspark.sql import functions as F

    bodies = [b for _, b in license_scan.TEMPLATES]
    said = [" ".join(w for w, keep in zip(b.rstrip(".").split(), RNG.random(99) < share, strict=False) if keep) + end for b in bodies for share in (0.5, 0.7, 0.9, 1) for end in ("", ".")]
    said += ["Released under the MIT.", "released_mit under the license", "(Licensed under ISC)", "and are that with without conditions met", "\u212aind of a license"]
    table = spark.createDataFrame([(x,) for x in sorted(set(said))], "statement string")
    chosen = table.select(F.explode(license_scan.statements(F.col("statement"), 0.7)).alias("statement"))
    every = sorted(map(tuple, license_scan.matched(table, 0.7).collect()))
    assert len(every) > 60 and ("Released under the MIT.", "MIT", 0.9612) in every
    assert sorted(map(tuple, license_scan.matched(chosen, 0.7).collect())) == every
    assert license_scan.telling((), 0.7) == ([], [])


def test_licence_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    link = duckdb.connect()
    link.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = link.sql(queries.ORACLES["op6_license_scan"]).fetchall()
    got = queries.op6_license_scan(spark, sf_dir).select("doc_id", "path", "licence", "basis", "score").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_mixing(spark, docs, rows):
    good = [(1000 + i, " ".join(prose(40))) for i in range(60)]
    odd = [(2000 + i, " ".join([*prose(30), *["idiot"] * 6])) for i in range(20)]
    table = spark.createDataFrame(good + odd, "doc_id long, text string")
    labelled = spark.createDataFrame([(k, "clean" if k < 2000 else "toxic") for k, _ in good + odd if k % 2] + [(None, "clean"), (1, "unknown")], "doc_id long, domain string")
    targets = {"clean": 0.5, "toxic": 0.5}
    got = mixing.mix(table, labelled, targets).collect()
    totals = np.sum([r.rate * r.n_tokens * np.array(r.posterior) for r in got], axis=0)
    assert totals / totals.sum() == pytest.approx([0.5, 0.5], abs=0.01)
    assert totals.sum() == pytest.approx(sum(r.n_tokens for r in got), rel=0.01)
    assert {r.domain for r in got if r.doc_id >= 2000} == {"toxic"} and {r.domain for r in got if r.doc_id < 2000} == {"clean"}
    only = mixing.mix(table.where("doc_id < 2000"), labelled, {"clean": 0.0, "toxic": 1.0}, total_tokens=1000.0).collect()
    assert all(r.rate >= 0 for r in only)
    awkward = mixing.mix(docs, labelled, targets).collect()
    assert len(awkward) == len(rows) and all(r.rate >= 0 and sum(r.posterior) == pytest.approx(1) for r in awkward)


def test_empty_tables(spark, docs, empty):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "doc_id long, quality int, domain string")
    assert ngram_join.jaccard_components(empty).count() == 0
    assert substring_dedup.dedup(empty).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    assert qda.classify(empty, none).count() == 0
    assert katz.score_documents(empty, F.lit(True)).count() == 0
    assert mixing.mix(empty, none, {"a": 1.0}).count() == 0
    assert decontam.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.contaminated(empty, spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0
    assert empty.select(langid.predicted_language(langid.learn(empty.withColumn("lang", F.lit("en"))))).count() == 0


def test_katz_untaught(spark, docs, rows):
    from pyspark.sql import functions as F

    got = katz.score_documents(docs, F.lit(False)).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {0} and {r.score for r in got} == {0.0}


def test_packed():
    for a in (np.arange(1000, dtype=np.int64), np.zeros(0, np.int64)):
        assert unpacked(packed(a), np.int64).tolist() == a.tolist()


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op5_compression_bands", "op8_suffix_dedup", "op9_katz_backoff", "op10_quality_classifier", "op2_soft_mixing", "op4_warc"])
def test_queries_return_every_row(spark, sf_dir, name):
    source = "pages" if name == "op4_warc" else "documents"
    key = "page_id" if name == "op4_warc" else "doc_id"
    want = sorted(r[0] for r in queries.table(spark, sf_dir, source).select(key).collect())
    assert sorted(r[0] for r in queries.QUERIES[name](spark, sf_dir).select(key).collect()) == want


def test_held_out_rows():
    assert [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 == 0]


def test_licence_headers(spark):
    """Wrapped notices as they stand in files, none of them word for word a template's lines."""
    gpl = """# Copyright (C) 2015 A. Writer
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
import os
"""
    apache = """/*
 * Licensed under the Apache License, Version 2.0 (the
 * "License"); you may not use this file except in compliance
 * with the License. You may obtain a copy of the License at
 *    https://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law or agreed to in writing,
 * software distributed under the License is distributed on an
 * "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.
 */
class A {}
"""
    bsd = """Redistribution and use in source and binary forms, with or
without modification, are permitted provided that the following conditions
are met:

  * Redistributions of source code must retain the above copyright notice,
    this list of conditions and the following disclaimer.
  * Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution.
"""
    isc = """Copyright 2020 Someone

Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.
"""
    lgpl = gpl.replace("GNU General", "GNU Lesser General").replace("program", "library").replace("# ", "dnl ")
    prose_around = " ".join(prose(900))
    texts = {1: ("GPL-3.0", gpl), 2: ("Apache-2.0", apache), 3: ("BSD-2-Clause", bsd), 4: ("ISC", isc), 5: ("LGPL-3.0", lgpl), 6: ("GPL-3.0", prose_around + "\n" + gpl + prose_around),
             7: ("EPL-2.0", "// SPDX-License-Identifier: EPL-2.0\nint x;"), 8: ("BSD-3-Clause", "# SPDX-License-Identifier: (BSD-3-Clause OR GPL-2.0-only)\n"), 9: (None, "# SPDX-License-Identifier: LicenseRef-Own\n"), 10: (None, prose_around + " license " + prose_around)}
    files = spark.createDataFrame([(k, f"{k}/f", t) for k, (_, t) in texts.items()], "doc_id long, path string, text string")
    got = {r.doc_id: r.licence for r in license_scan.scan(files).collect()}
    assert got == {k: x for k, (x, _) in texts.items()}
