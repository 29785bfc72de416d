"""Operators that compare documents with each other, archives, and the pipeline."""

import base64
import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gapweave.llm import lines, nearcopies, phrases, repeats, warc
from gapweave.session import new_folder

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def tally(rows):
    return Counter(tuple(r) for r in rows)


# --- line windows ---------------------------------------------------------


def line_windows(p):
    """Places and lines of all windows; a shorter text is one of its own length, an empty one has none."""
    if len(p) < 3:
        return [(0, tuple(p))] if p not in ([], [""]) else []
    return [(k, tuple(p[k:k + 3])) for k in range(len(p) - 2)]


def brute_lines(rows):
    first, docs = {}, sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: x[:2])
    for has, i, t in docs:
        for k, w in line_windows(t.split("\n")):
            first.setdefault(w, []).append((has, i, t, k))
    out = []
    for i, t in rows:
        p = t.split("\n") if t is not None else []
        gone = set()
        for k, w in line_windows(p):
            least = min(first[w], key=lambda x: (x[:2], x[3]))
            if least != (i is not None, i or 0, t, k):
                gone |= set(range(k, k + len(w)))
        spans = sum(k - 1 not in gone for k in gone)
        kept = "\n".join(x for k, x in enumerate(p) if k not in gone)
        out.append((i, len(p), len(gone), spans, hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_lines(spark, awkward, empty, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert tally(lines.digests(docs).collect()) == Counter(brute_lines(rows))
    odd = awkward.where("doc_id is null or doc_id <> 2")
    assert tally(lines.digests(odd).collect()) == Counter(brute_lines([(r.doc_id, r.text) for r in odd.collect()]))
    assert lines.digests(empty).count() == 0
    repeated = lines.digests(awkward.where("doc_id = 2")).collect()
    assert [r.n_removed for r in repeated] == [0, 0]
    cleaned = lines.clean(awkward)
    assert cleaned.columns == awkward.columns and cleaned.where("doc_id = 2").count() == 0 and cleaned.where("doc_id = 3").count() == 1


# --- near copies ----------------------------------------------------------


def shingles(text):
    w = TOKEN.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(root(i), []).append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        known = [x for x in least[root(i)] if x is not None]
        c = min(known) if known else None
        out.append((k, len(sets[i]), c if sets[i] else k, (k == c) if sets[i] else True))
    return out


def variants(n, words, edits, seed, base=None):
    rng = random.Random(seed)
    base = base or [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_copies(spark, awkward, empty):
    chain = [" ".join(f"c{k}" for k in range(s, s + 200)) for s in range(0, 120, 8)]  # each linked with the next alone
    rows = [*enumerate([*variants(60, 120, 4, 1), *variants(40, 80, 3, 2), *chain, *variants(10, 3, 1, 3), "", "one", "one", "ONE  "], 100)]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert tally(nearcopies.near_copies(docs).collect()) == Counter(brute_groups(rows))
    odd = [(r.doc_id, r.text) for r in awkward.collect()]
    assert tally(nearcopies.near_copies(awkward).collect()) == Counter(brute_groups(odd))
    assert nearcopies.near_copies(empty).count() == 0
    one = nearcopies.one_of_each(awkward)
    assert one.columns == awkward.columns and one.where("doc_id = 2").count() == 0 and one.where("doc_id = 1").count() == 1


def test_large_bucket_in_blocks(spark, monkeypatch):
    """Groups larger than a block, and members linked only across blocks."""
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    monkeypatch.setattr(nearcopies, "PAIRS", 64)
    rows = [*enumerate([*variants(50, 150, 5, 7), *variants(45, 100, 6, 8)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert tally(nearcopies.near_copies(docs).collect()) == Counter(brute_groups(rows))


def test_unlinked_nodes_of_a_bucket_are_dealt_out(spark, monkeypatch):
    """Nodes outside a bucket's largest component: bounded groups, every pair of components once, bounded pairs."""
    rng, block = np.random.default_rng(5), 16
    node = [bytes([i, 7]) for i in range(200)]
    comp = [node[max(i, 49)] for i in range(200)]
    nodes = spark.createDataFrame([(n, c, rng.bytes(128)) for n, c in zip(node, comp, strict=True)], "node binary, comp binary, signature binary")
    members = spark.createDataFrame([(0, 1, n) for n in node], "band int, bucket long, node binary")
    sets = spark.createDataFrame([], "node binary, shingles binary")
    task, dealt = nearcopies._block_task, []
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "PAIRS", 100)
    monkeypatch.setattr(nearcopies, "_block_task", lambda least, percent: lambda batches: batches if percent is None else iter(()))
    monkeypatch.setattr(nearcopies, "settle_table", lambda df, label: dealt.append(df) or df)
    nearcopies.wave(members, nodes, sets, 85, 1, True)
    groups = {}
    table = dealt[0].toArrow().sort_by([("bucket", "ascending"), ("block", "ascending")])
    for r in table.to_pylist():
        groups.setdefault((r["bucket"], r["block"]), []).append(r)
    assert max(map(len, groups.values())) <= 4 * block
    met = Counter()
    for rows in groups.values():
        met.update(frozenset((x["node"], y["node"])) for i, x in enumerate(rows) for y in rows[:i] if x["comp"] != y["comp"] and (x["side"] != y["side"] or x["side"] == 2))
    assert met == Counter(frozenset((node[i], node[j])) for i in range(200) for j in range(i) if comp[i] != comp[j])
    sizes = []
    monkeypatch.setattr(nearcopies, "estimate", lambda a, b: sizes.append(len(a)) or np.ones(len(a)))
    assert sum(map(len, task(0.5, None)(iter(table.combine_chunks().to_batches())))) == len(table)
    assert sum(sizes) == len(met) and max(sizes) <= 100


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.85, 0.95):
        common, own = int(1000 * share), int(1000 * (1 - share) / 2)
        pool = rng.integers(0, 2**63, common + 2 * own, dtype=np.uint64)
        a, b = np.unique(pool[:common + own]), np.unique(np.r_[pool[:common], pool[common + own:]])
        packed = nearcopies._pack(nearcopies._minima([a, b]))
        assert packed.shape == (2, nearcopies.MINIMA * nearcopies.BITS // 8)
        assert abs(nearcopies.estimate(packed[:1], packed[1:])[0] - common / len(set(pool.tolist()))) < 0.16


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(bytes([i // 256, i % 256]), bytes([(i + 1) // 256, (i + 1) % 256])) for i in range(300)], "a binary, b binary")
    got = nearcopies.components(links).collect()
    assert len(got) == 301 and {bytes(r.comp) for r in got} == {b"\0\0"}
    assert nearcopies.components(links.limit(0)).count() == 0


# --- benchmark ------------------------------------------------------------


def brute_contamination(rows, items):
    wins = {}
    for item, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k:k + 10]), set()).add(item)
    sizes = {len(g) for g in wins}
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("group", [4 << 20, 500])
def test_contamination(spark, awkward, empty, small, monkeypatch, group):
    monkeypatch.setattr(phrases, "GROUP_BYTES", group)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    items = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").union(
        spark.createDataFrame([(900, "mit license"), (900, "word"), (901, ""), (902, None), (903, "license"), (904, "long " * 12), (905, "The of")], "item_id long, text string"))
    want = Counter(brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()]))
    got = phrases.contamination(docs, items).drop("n_near").collect()
    assert tally(got) == want and sum(r.contaminated for r in got) > 5
    assert phrases.contamination(empty, items).count() == 0
    none = phrases.contamination(awkward, items.limit(0)).collect()
    assert len(none) == awkward.count() and not any(r.contaminated for r in none)
    kept = phrases.clean(awkward, items)
    assert kept.columns == awkward.columns and kept.where("doc_id in (5, 8, 10)").count() == 0 and kept.where("doc_id = 1").count() == 1


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma z"), (2, "alpha " + "x " * 60 + "beta gamma"), (3, "gamma beta"), (4, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.key: (len(r.hits), r.near) for r in phrases.search(phrases.build_index(docs), items).collect()}
    assert got == {1: (0, [1]), 2: (0, []), 3: (0, []), 4: (1, [1])}


# --- repeated strings -----------------------------------------------------


def brute_repeats(rows):
    least = {}
    for i, t in rows:
        b, i = (t or "").encode(), -(1 << 63) if i is None else i
        for p in range(len(b) - 49):
            s = b[p:p + 50]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, t in rows:
        b, n = (t or "").encode(), -(1 << 63) if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p:p + 50]] < n:
                gone[p:p + 50] = b"\1" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("part", [4 << 20, 3000])
def test_repeats(spark, awkward, empty, monkeypatch, part):
    for name in ("SLICE_BYTES", "BUCKET_BYTES"):
        monkeypatch.setattr(repeats, name, part)
    monkeypatch.setattr(repeats, "SORTED_BYTES", part // 10)
    rng = random.Random(4)
    passage = ["".join(rng.choices("abcdé ", k=n)) for n in (49, 50, 51, 52, 55, 60, 75, 200)]
    rows = [(i, "".join(rng.choices(string.ascii_letters + " ü", k=rng.randrange(120))) + rng.choice(passage) + "".join(rng.choices(string.ascii_letters, k=rng.randrange(9))) + rng.choice([*passage, ""]))
            for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "q" * 300), (203, "q" * 51), (204, "q" * 49), (205, "ab" * 100), (206, "ba" * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.removals(docs, kept=True)
    got = out.collect()
    assert tally(r[:5] for r in got) == Counter(brute_repeats(rows))
    assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in got)
    if part > 3000:
        odd = [(r.doc_id, r.text) for r in awkward.collect()]
        assert tally(repeats.removals(awkward).collect()) == Counter(brute_repeats(odd))
        assert repeats.removals(empty).count() == 0


def test_repeats_behind_one_frequent_lead(spark, monkeypatch):
    """Eight bytes that begin most suffixes do not bring these together: buckets go by what the strings share."""
    monkeypatch.setattr(repeats, "SLICE_BYTES", 2000)
    monkeypatch.setattr(repeats, "SORTED_BYTES", 500)
    rng = random.Random(9)
    tails = ["".join(rng.choices("xyz", k=70)) for _ in range(25)]
    rows = [(i, "".join(" " * 56 + rng.choice(tails) for _ in range(4))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert tally(repeats.removals(docs).collect()) == Counter(brute_repeats(rows))


# --- archives -------------------------------------------------------------


def test_warc(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)] + [(60, None, None), (None, "a", "twice without an id"), (None, "b", "twice without an id"), (61, "http://é/\r\n", "é漢\r\n\r\nbody"), (None, "http://none", "<p>1</p>"), (62, "u", "y" * 300000), (62, "u", "y" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    largest, many = {}, Counter(h or "" for _, _, h in rows)
    for i, u, h in rows:
        largest[h or ""] = max((i is not None, i or 0, u or ""), largest.get(h or "", (False, 0, "")))
    want, seen = Counter(), set()
    for i, u, h in rows:
        data, last = (h or "").encode(), largest[h or ""]
        revisit = many[h or ""] > 1 and ((i is not None, i or 0, u or "") != last or h in seen)
        if not revisit:
            seen.add(h)
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[1] if revisit and last[0] else None)] += 1
    assert tally(warc.digests(pages, new_folder(spark, "warc-test")).collect()) == want
    # More than one file a task, and payloads as they were.
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    manifest = warc.write(warc.plan(pages), str(tmp_path / "w"), warc.dictionary(pages))
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    back = {r.page: r.payload for r in warc.read(spark, manifest).where("record_type = 'response' and page is not null").collect()}
    assert all(back[str(i)] == (h or "") for i, _, h in rows if i is not None and largest[h or ""][1] == i)
    # Below the limit every record is a response.
    alone = warc.plan(pages, least=10**6).where("refers_to is not null or kind = 'revisit'").count()
    assert alone == 0
    assert warc.digests(pages.limit(0), new_folder(spark, "warc-none")).count() == 0


def test_warc_frames(spark, tmp_path):
    """The file is a skippable frame with the dictionary and a frame per record."""
    import struct
    from pathlib import Path

    import zstandard

    pages = spark.createDataFrame([(i, "u", f"<html>{i}" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write(warc.plan(pages), str(tmp_path), warc.dictionary(pages)).count()
    raw = next(Path(tmp_path).glob("*.warc.zst")).read_bytes()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8:8 + size]))
    rest, n = raw[8 + size:], 0
    while rest:
        d = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        assert d.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, n = d.unused_data, n + 1
    assert n == 20


# --- pipeline -------------------------------------------------------------


def test_pipeline(spark, awkward, empty, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[:len(names)] == names and 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("not round_trip").count() == 0 and docs.count() == docs.select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, small)
    assert tally((r.doc_id, r.text) for r in whole.collect()) == tally((r.doc_id, r.text) for r in docs.collect())


def test_stages_on_awkward_rows(spark, awkward, empty, small):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, small)
        assert set(awkward.columns) <= set(out.columns) and out.count() <= awkward.count()
        assert stage(spark, empty, small).count() == 0
