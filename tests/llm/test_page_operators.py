"""Media, archives and URL rules."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tsledger.llm import common, media, urls, warc

# ---- media


def payloads():
    rnd = random.Random(2)
    mixed = lambda n: bytes(rnd.choice([128, 128, 128, 127, 129, 0, 255, rnd.randrange(256)]) for _ in range(576 * n))
    return [mixed(1), mixed(2), bytes([128]) * 576, mixed(70), bytes(576), bytes([255]) * 576, bytes([128]) * 575 + b"\x01", b"plain text " * 576, bytes(range(256)) * 9]


def test_round_trip_and_batches():
    own = payloads()
    files = media.encode(own)
    assert [x[0] for x in media.decode(files)] == own
    assert [media.encode([p])[0] for p in own] == files
    alone = [media.decode([f], True)[0] for f in files]
    assert alone == media.decode(files, True)
    assert media.ZIGZAG.tolist()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG) == list(range(64))


def test_long_payloads_in_parts(monkeypatch):
    own = payloads()
    files = media.encode(own)
    monkeypatch.setattr(media, "CHUNK", 7)
    assert media.encode(own) == files and [x[0] for x in media.decode(files)] == own


def test_scans_are_progressive():
    f = media.File(media.encode(payloads()[:1])[0])
    kinds = [s[0] for s in f.scans]
    assert kinds[0] == ((0, 1, 2), 0, 0, 0, 1) and kinds[-1] == ((0, 1, 2), 0, 0, 1, 0) and any(k[3:] == (1, 0) and k[1] for k in kinds)
    for bad in (b"", b"\xff\xd8\xff\xd9", media.encode(payloads()[:1])[0][:-40], media.encode(payloads()[:1])[0].replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises((ValueError, IndexError)):
            media.decode([bad])


def test_transform_against_the_formula():
    rnd = np.random.default_rng(1)
    coefs = rnd.integers(-128, 128, (2, 9, 64))
    got = media.samples(coefs.astype(np.int32))
    c = lambda u: np.sqrt(0.5) if u == 0 else 1
    block = np.zeros(64)
    block[media.ZIGZAG] = coefs[1, 4]
    block = block.reshape(8, 8)
    want = [[sum(c(u) * c(v) / 4 * block[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128 for y in range(8)] for x in range(8)]
    assert np.abs(got[1, 4] - np.clip(np.array(want), 0, 255)).max() <= 1


def test_colours_and_doubling():
    s = np.full((1, 9, 8, 8), 128, np.int32)
    s[0, 8, 0, 0] = 228
    rgb = media.unit_rgb(s)[0]
    assert (rgb[:2, :2, 0] == 255).all() and (rgb[2:, :, 0] == 128).all() and (rgb[..., 2] == 128).all() and rgb[0, 0, 1] == 128 - 71


def test_media_columns(spark):
    texts = [(1, None), (2, ""), (3, "x" * 576), (4, "é" * 400), (5, "word " * 9000), (6, "x" * 576), (None, "a"), (1, "again")]
    frame = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, media string")
    got = media.read_media(media.media_columns(frame), True).collect()
    want = Counter()
    for d, t in texts:
        data = (t or "").encode()
        full = data + b"\xff" * (576 if not data else -len(data) % 576)
        want[(d, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by = defaultdict(set)
    for r in got:
        by[r.payload_sha256].add((r.media_sha256, r.media_bytes, r.feature))
        assert len(r.tensor) == r.height * r.width * 3
    assert all(len(v) == 1 for v in by.values())
    assert media.read_media(media.media_columns(frame.filter("false"))).collect() == []


def slow_image(payload):
    """Pixels straight from a payload, by the formulas: no JPEG, no integer arithmetic, one sample after another."""
    units = [payload[k : k + 576] for k in range(0, len(payload), 576)]
    wide = min(len(units), 64)
    high = -(-len(units) // wide)
    units += [bytes([128]) * 576] * (wide * high - len(units))  # blocks of a grid's last places are empty
    order = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    basis = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    image = np.zeros((high * 16, wide * 16, 3))
    for n, unit in enumerate(units):
        blocks = []
        for k in range(9):
            c = np.zeros((8, 8))
            for value, (row, column) in zip(unit[64 * k : 64 * k + 64], order):
                c[row, column] = value - 128
            blocks.append(np.clip(np.round(basis.T @ c @ basis + 128), 0, 255))
        square = lambda four: np.block([[four[0], four[1]], [four[2], four[3]]])
        y, cb, cr = square(blocks[0:4]), square(blocks[4:8]) - 128, np.kron(blocks[8], np.ones((2, 2))) - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        top, left = 16 * (n // wide), 16 * (n % wide)
        image[top : top + 16, left : left + 16] = np.clip(np.round(rgb), 0, 255)
    return image


def test_features_and_tensors_against_the_formulas(spark):
    rnd = random.Random(4)
    texts = ["", "plain text " * 40, "".join(chr(rnd.randrange(32, 0x2FF)) for _ in range(3000)), "Ünï " * 9300]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place = media.store_media(frame, media.Stored.at(common.table_path(spark, "media-test")))
    stored = {r.doc_id: r for r in media.read_tensors(spark, place).collect()}
    for r in media.read_media(spark.read.parquet(place.media)).collect():
        image = slow_image(media.payload_of(texts[r.doc_id]))
        tensor = np.frombuffer(stored[r.doc_id].tensor, np.uint8).reshape(stored[r.doc_id].height, stored[r.doc_id].width, 3)
        assert tensor.shape == image.shape and np.abs(tensor - image).max() <= 3 and np.abs(tensor - image).mean() < 0.05 and stored[r.doc_id].media_sha256 == r.media_sha256
        shape, means = r.feature.split(":")[:2]
        assert shape == f"{image.shape[0]}x{image.shape[1]}"
        assert np.allclose([float(x) for x in means.split(",")], image.mean(axis=(0, 1)), atol=0.2)
        assert float(r.feature.split(":")[2]) == pytest.approx((image[..., 1] ** 2).mean(), abs=40)


def test_query_stores_tensors_and_reads_them_back(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "plain text " * 90), (4, "é" * 400), (5, "word " * 9000), (3, "again"), (None, "plain text " * 90)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    result = media.op9_media(spark, str(tmp_path))
    place = media.Stored.at(common.MADE[-1])
    assert result.inputFiles() and all(f.rsplit("/", 2)[-2] == "tensors" for f in result.inputFiles())
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "height", "width", "feature")
    rows = Counter(tuple(r) for r in result.collect())
    assert result.columns == list(columns) and rows == Counter(tuple(r) for r in media.read_media(spark.read.parquet(place.media)).collect())
    by = {hashlib.sha256(media.payload_of(t)).hexdigest(): t for _, t in texts}
    stored = media.read_tensors(spark, place).collect()
    assert Counter(r.doc_id for r in stored) == Counter(d for d, _ in texts)
    for r in stored:
        image = slow_image(media.payload_of(by[r.payload_sha256]))
        tensor = np.frombuffer(r.tensor, np.uint8).reshape(r.height, r.width, 3)
        assert tensor.shape == image.shape and np.abs(tensor - image).max() <= 3
    plain = spark.createDataFrame([(7, 2, 3, bytes([10, 20, 30]) * 6)], "id long, height int, width int, tensor binary")
    assert [tuple(r) for r in media.read_features(plain).collect()] == [(7, 2, 3, "2x3:10.000,20.000,30.000:400.00")]
    frame.filter("false").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert media.op9_media(spark, f"{tmp_path}/empty").collect() == []


def test_stored_media_of_texts_are_small(spark, tmp_path):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(300, 900))) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    media.store_media(frame, media.Stored.at(str(tmp_path)), tensors=False)
    stored = sum(f.stat().st_size for f in tmp_path.glob("media/*.parquet"))
    assert stored < 0.55 * sum(map(len, texts))
    size = np.arange(1, 8)
    assert (media.AC_SIZES[size] + size == 8).all() and (media.AC_SIZES[16 + size] + size == 16).all()
    assert [x[0].rstrip(b"\xff").decode() for x in media.decode(media.encode([media.payload_of(t) for t in texts]))] == texts


# ---- archives


def test_warc(spark):
    big, other = "<p>" + "x" * 1200, "<p>" + "y" * 997
    pages = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (2, "u", "small"), (4, "u\r\nWARC-Type: forged", "small"), (6, "é", "é" * 500), (7, "e", "é" * 500), (8, "n", None), (9, "m", ""), (10, "o", other), (5, "http://a/5", big), (None, "z", big)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    archive = warc.write_archive(frame, warc.Archive.at(common.table_path(spark, "warc-test")))
    got = warc.read_archive(spark, archive).collect()
    assert len(got) == len(pages) and spark.read.parquet(archive.payloads).count() == len({p[2] or "" for p in pages})
    best = {}
    for i, _, h in pages:
        h = h or ""
        if len(h.encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    want = Counter()
    for k, (i, _, h) in enumerate(pages):
        h = h or ""
        # of two rows with the largest id the first is the response
        revisit = h in best and (i != best[h] or any(p[0] == i and p[2] == h for p in pages[:k]))
        want[(i, h.encode(), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None)] += 1
    assert Counter((r.page_id, bytes(r.payload), r.sha1, r.record_type, r.refers_to) for r in got) == want
    for r in warc.warc_records(spark, archive).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split()[1])
        assert len(body) == n + 4 and head.startswith(b"WARC/1.1\r\nWARC-Type: re")
    empty = warc.write_archive(frame.filter("false"), warc.Archive.at(common.table_path(spark, "warc-test")))
    assert warc.read_archive(spark, empty).collect() == []


def test_damaged_payloads_are_found(spark):
    frame = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    archive = warc.write_archive(frame, warc.Archive.at(common.table_path(spark, "warc-test")))
    stored = spark.read.parquet(archive.payloads).collect()
    frames = spark.createDataFrame([(bytes(r.digest), zstandard.compress(b"other")) for r in stored], "digest binary, frame binary")
    frames.write.mode("overwrite").parquet(archive.payloads)
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, archive).collect()
    frames.withColumn("frame", F.lit(b"no frame")).write.mode("overwrite").parquet(archive.payloads)
    with pytest.raises(Exception, match="cannot be unpacked"):
        warc.read_archive(spark, archive).collect()


def test_records_are_exact(spark):
    """Ids never repeat, references lead to their response, urls come back exactly, repeated largest ids have one response."""
    big, url = "<p>é" + "x" * 1200, "http://é/1\r\nWARC-Refers-To-Page: 77\n"
    forged = "\r\nWARC-Refers-To-Page: 9\r\n" + "y" * 1000
    rows = [(1, url, big), (2, "b", big), (2, "b", big), (1, url, "small"), (1, url, "small"), (None, None, None), (4, "f", forged), (4, "f", forged + "z")]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, FRAME string, row int")
    archive = warc.write_archive(frame, warc.Archive.at(common.table_path(spark, "warc-test")))
    got = warc.warc_records(spark, archive).collect()
    assert sorted((r.page_id or 0, r.url) for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
    fields = [dict(line.split(": ", 1) for line in bytes(r.record).decode().split("\r\n\r\n")[0].split("\r\n")[1:]) for r in got]
    ids = {f["WARC-Record-ID"]: f for f in fields}
    assert len(ids) == len(rows)
    again = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert len(again) == 2 and {ids[f["WARC-Refers-To"]]["WARC-Page-ID"] for f in again} == {"2"} == {f["WARC-Refers-To-Page"] for f in again}
    assert all(bytes(r.payload).decode() in {x[2] or "" for x in rows} for r in got)


# ---- urls


def slow_rule(host, path):
    fits = [(h, p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def test_rules(spark):
    cases = ["http://a.Example.COM/en/7x", "https://example.com/en/8", "com/en/9", None, "http://com/en/", "x://b.net/de/8", "x://example.net/de/8/9", "x://b.example.net/de/81?x#y", "x://notexample.net/de/8", "http://org#/es/", "http://a.org/es/q", "http://org/ES/", "://net/de/", "a://b://c.com/en/", "http://É.COM/en/1"]
    frame = spark.createDataFrame([(k, u, "x") for k, u in enumerate(cases)] + [(0, cases[0], "y")], "page_id long, url string, rule string")
    got = urls.filter_urls(frame).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        u = cases[r.page_id]
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            tail = rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        rule = slow_rule(host, path)
        assert (r.host, r.path) == (host, path) and r.rule == (rule and rule[0] + rule[1])
        if rule:
            assert r.verdict == rule[2]
    assert urls.filter_urls(frame.filter("false")).collect() == []


def test_templates(spark):
    """Labels reject the template of a listing, spare the other, and merge branches that look alike."""
    pages, labels = [], []
    for k in range(40):
        pages += [(k, f"http://h.io/spam/item-{k}.html"), (100 + k, f"http://h.io/news/{k}/"), (200 + k, f"http://h.io/a{'bcdefghij'[k % 9]}/page/{k}/x")]
    pages += [(300 + k, f"http://h.io/tag/{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'xyz'[k // 26]}") for k in range(70)]
    labels += [(f"http://h.io/spam/item-{k}.html", "block") for k in range(20)] + [(f"http://h.io/news/{k}/", "allow") for k in range(20)]
    labels += [(f"http://h.io/a{c}/page/{n}/x", "allow" if n % 2 else "block") for c in "bcdefghij" for n in range(8)]
    pages += [(400, "http://h.io/spam/other"), (401, "http://h.io/"), (402, "http://www.b.h.io/q"), (403, "http://else.org/q")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    given = spark.createDataFrame(labels, "url string, ruled string")
    got = {r.page_id: r for r in urls.filter_urls(frame, (), given).collect()}
    assert got[30].template == "/spam/item-{n}.html" and got[30].verdict == "block" and got[30].purity == pytest.approx(21 / 22)
    assert got[130].template == "/news/{n}/" and got[130].verdict == "allow"
    assert got[300].template == "/tag/*" and len(got) == len(pages)
    assert got[400].judged_by == "branch" and got[400].purity == pytest.approx(0.5 + 0.7 * (21 / 22 - 0.5)) and got[400].verdict == "block"
    assert got[401].judged_by == "host" and got[402].judged_by == "domain" and got[403].judged_by == "none" and got[403].purity == 0.5
    assert {got[k].judged_by for k in range(200, 240)} == {"template"} and all(got[k].verdict == "allow" for k in range(200, 240))


@pytest.mark.parametrize("wide", [10, 50, 51, 400])
def test_a_bad_branch_stays_apart_in_a_wide_node(spark, wide):
    names = ["".join("abcdefghij"[int(d)] for d in f"{k:03d}") for k in range(wide)]
    pages = [(k * 10 + n, f"http://h.io/{name}/{n}") for k, name in enumerate(names) for n in range(8)]
    labels = [(u, "block" if u.startswith("http://h.io/aaa/") else "allow") for _, u in pages]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), (), spark.createDataFrame(labels, "url string, ruled string")).collect()
    for r in got:
        bad = r.path.startswith("/aaa/")
        assert r.verdict == ("block" if bad else "allow") and r.template == ("/aaa/{n}" if bad else "/*/{n}")


def slow_templates(paths):
    """Of {(host, path): [blocked, allowed]}: template, purity and whose labels, by the module's rules."""
    import re

    def shaped(s):
        s = re.sub(r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|(?<![0-9a-zA-Z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{12,}(?![0-9a-zA-Z])", "{h}", s)
        return re.sub("[0-9]+", "{n}", s)

    def kind(s):
        return 0 if not s else 1 if s == "{n}" else 3 if "{h}" in s else 2 if "{n}" in s else 4 if "." in s else 5

    segments = {k: ([] if k[1] == "" else re.sub("^/", "", shaped(k[1])).split("/")) for k in paths}
    kids = defaultdict(lambda: [0, 0, 0, *[0] * urls.KINDS])
    for k, (b, a) in paths.items():
        s = segments[k]
        for level, seg in enumerate(s):
            own = kids[(k[0], tuple(s[:level]), seg)]
            own[0] += 1
            own[1] += b
            own[2] += b + a
            own[3 + kind(s[level + 1] if level + 1 < len(s) else None)] += 1
    nodes, rare = defaultdict(lambda: [0] * (3 + urls.KINDS)), defaultdict(int)
    for (h, node, _), own in kids.items():
        nodes[(h, node)] = [x + y for x, y in zip(nodes[(h, node)], own)]
        rare[(h, node)] += own[0] <= urls.RARE
    label = {}
    for (h, node, seg), own in kids.items():
        whole = nodes[(h, node)]
        rest = [x - y for x, y in zip(whole, own)]
        share = whole[1] / max(whole[2], 1)
        gap = abs(own[1] / max(own[2], 1) - rest[1] / max(rest[2], 1))
        spread = (share * (1 - share) * (1 / max(own[2], 1) + 1 / max(rest[2], 1))) ** 0.5
        differs = own[2] >= urls.LEAST and rest[2] >= urls.LEAST and gap > urls.BOUND * spread
        far = sum(abs(x / own[0] - y / max(rest[0], 1)) for x, y in zip(own[3:], rest[3:])) / 2
        chance = urls.BOUND * ((1 / own[0] + 1 / max(rest[0], 1)) / 4) ** 0.5
        alike = own[0] >= urls.LEAST and rest[0] >= urls.LEAST and far <= urls.ALIKE + chance
        wild = not differs and (alike or (own[0] <= urls.RARE and rare[(h, node)] >= urls.MANY))
        label[(h, node, seg)] = "*" if wild else seg
    template = {k: "".join("/" + label[(k[0], tuple(s[:n]), x)] for n, x in enumerate(s)) for k, s in segments.items()}
    count = defaultdict(lambda: [0, 0])
    for k, (b, a) in paths.items():
        parts = template[k].split("/")
        for key in {("t", k[0], template[k]), ("d", ".".join(k[0].split(".")[-2:])), *(("b", k[0], "/".join(parts[:n])) for n in range(1, len(parts) + 1))}:
            count[key][0] += b
            count[key][1] += b + a
    out = {}
    smooth = lambda c: (c[0] + 1) / (c[1] + 2)
    for k in paths:
        parts, own = template[k].split("/"), count[("t", k[0], template[k])]
        above = next((n for n in range(len(parts), 0, -1) if count[("b", k[0], "/".join(parts[:n]))][1]), None)
        domain = count[("d", ".".join(k[0].split(".")[-2:]))]
        if own[1]:
            out[k] = template[k], smooth(own), "template"
        elif above:
            out[k] = template[k], 0.5 + 0.7 * (smooth(count[("b", k[0], "/".join(parts[:above]))]) - 0.5), "host" if above == 1 else "branch"
        else:
            out[k] = template[k], 0.5 + 0.49 * (smooth(domain) - 0.5) if domain[1] else 0.5, "domain" if domain[1] else "none"
    return out


def test_trees_against_brute_force(spark):
    rnd = random.Random(8)
    pages = []
    for k in range(900):
        host = rnd.choice(["a.com", "a.com", "b.net", "c.org", "x.io", "www.a.com", "only.example.org"])
        parts = [rnd.choice(["en", "de", "es", "fr", f"t{rnd.choice('abcdefgh')}"]) if host != "www.a.com" else "fr", rnd.choice([str(rnd.randrange(900)), f"{rnd.randrange(99)}.html", "deadbeef00112233", "".join(rnd.choice("abcdef") for _ in range(2))]), *["deep"] * rnd.choice([0, 0, 0, 1, 20])]
        pages.append((k, f"http://{host}/" + "/".join(parts) + rnd.choice(["", "/", "?q=1"])))
    pages += [(1000, None), (1001, "http://a.com"), (1002, "http://a.com/"), (1003, "nothing")]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string")).collect()
    paths = defaultdict(lambda: [0, 0])
    for r in got:
        rule = slow_rule(r.host, r.path)
        own = paths[(r.host, r.path)]
        own[0] += bool(rule) and rule[2] == "block"
        own[1] += bool(rule) and rule[2] == "allow"
    want = slow_templates(dict(paths))
    assert len(got) == len(pages)
    for r in got:
        rule = slow_rule(r.host, r.path)
        template, purity, by = want[(r.host, r.path)]
        assert (r.template, r.judged_by) == (template, by) and r.purity == pytest.approx(purity)
        assert r.verdict == (rule[2] if rule else "block" if purity >= urls.PURITY else "allow")
    assert any("*" in r.template for r in got) and {"template", "host", "domain", "none"} <= {r.judged_by for r in got}
