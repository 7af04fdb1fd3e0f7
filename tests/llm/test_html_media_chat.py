import gzip
import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

from pyspark.sql import functions as F

from panelframe.llm import chat, html, media, queries

SF = "/root/testdata/sf0.001"


def text_of(page):
    return html.main_text(page, set())[0]


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
      <header><p>site</p></header><nav><ul><li><a href="/x">x</a></li></ul></nav>loose <b>words</b><aside>side</aside>
      <article><h1>Head &amp; line</h1><p><b>One.<br><p>Two&nbsp;three
      four &lt;x&gt;</p><ul><li>a<li>b</ul><form>q<input></form><div id="comments"><p>reader</p></div></article>
      <footer>&copy; f</footer></body></html>"""
    assert text_of(page) == "Head & line\n\nOne.\n\nTwo three four <x>\n\na\n\nb"


def test_odd_pages():
    assert text_of(None) == "" and text_of("") == "" and text_of("<p") == "" and text_of("plain & text") == "plain & text"
    assert text_of("<article><p>cut") == "cut" and text_of("<div>a<div>b</div>c</div>") == "a\n\nb\n\nc"
    assert text_of("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert text_of("<article><p>a<!-- <p>no --><script>1<2</script>b</article>") == "ab"


def test_template_goes_and_passages_stay(spark):
    def page(i):
        return f"<body><div><span>Read all our stories</span></div><div class=x1>Follow us everywhere</div><div><p>Story {i} of the day.</p><p>Quoted passage.</p></div></body>"

    rows = [(i, "http://a.example/p", page(i)) for i in range(20)] + [(100, "http://b.example/", page(100)), (101, None, None), (102, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text0", F.lit(1))
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got[3] == "Story 3 of the day."
    assert got[100].startswith("Read all our stories") and got[101] == "" and got[102] == ""
    art = [(i, "http://a.example/p", f"<article><h1>H{i}</h1><p>Quoted passage of many pages.</p><div>Sign in here</div></article>") for i in range(20)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(art, "page_id long, url string, html string")).collect()}
    assert got[7] == "H7\n\nQuoted passage of many pages."
    same = [(i, "http://a.example/p", "<article><h1>H</h1><div>Only text</div></article>") for i in range(20)]
    got = {r.text for r in html.extract(spark.createDataFrame(same, "page_id long, url string, html string")).collect()}
    assert got == {"H\n\nOnly text"}
    assert html.extract(df.limit(0)).count() == 0


def png():
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_validators():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "hello")
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04ab\xff\xda\x00\x02xx\xff\xd9"
    pdf = b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"
    for kind, b in {"wav": media.to_wav(b"abc"), "png": png(), "gif": gif, "jpeg": jpeg, "bmp": bmp, "pdf": pdf, "zip": z.getvalue(), "gzip": gzip.compress(b"x")}.items():
        assert media.find_media(b) == [(kind, 0, len(b))], kind
        assert (kind, 3, len(b)) in media.find_media(b"..." + b + b"..")
        assert not media.find_media(b[: len(b) - 2]), kind
    assert media.find_media(b"BM PK\x03\x04 RIFF GIF8 %PDF- \xff\xd8\xff \x1f\x8b\x08") == []


def test_long_values_full_of_magic_bytes():
    """Half a megabyte of starts without ends takes about its length."""
    starts = [b"%PDF-1", b"PK\x03\x04", b"\xff\xd8\xff\xe0\x00\x02", b"\x1f\x8b\x08\0\0\0\0\0\0\0\x01\x04\0\xfb\xffabcd", b"GIF89a\0\0\0\0\0\0\0!\x01\0", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR", b"BM RIFF"]
    for s in starts:
        began = time.perf_counter()
        assert media.find_media(s * (500_000 // len(s))) == []
        assert time.perf_counter() - began < 20, s
    twice = gzip.compress(b"x" * 100_000) + png() * 2
    assert [k for k, *_ in media.find_media(twice)] == ["gzip", "png", "png"]


def test_query_stores_types_and_carves(spark):
    """op4 by the standard library: digests, tail, type and the carved attachment."""
    got = queries.op4_media_sniffing(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = io.BytesIO()
        with wave.open(stored, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored.getvalue()), hashlib.sha256(stored.getvalue()).hexdigest())
        assert (r.declared, r.media_type, r.media_type_wrong, r.carved_type, r.carved_sha256) == ("text/plain", "wav", True, "wav", r.media_sha256) and r.n_carved >= 1


def test_types_and_carving(spark):
    rows = [(1, "image/png", media.to_wav(b"abc")), (2, "png", png()), (3, "text", b"xx" + png() + media.to_wav(b"q")), (4, None, None), (5, "JPG", b"")]
    df = spark.createDataFrame(rows, "id int, declared string, value binary").withColumn("kind", F.lit("clash"))
    out = media.correct_types(df.drop("kind"), "value", "declared")
    got = {r.id: r for r in out.collect()}
    assert (got[1].media_type, got[1].media_type_wrong) == ("wav", True) and (got[2].media_type, got[2].media_type_wrong) == ("png", False)
    assert got[3].media_type is None and len(got[3].media) == 2 and got[4].media_type is None and got[5].media == []
    cut = media.carve(out, "value").collect()
    clash = media.carve(out.withColumns({"kind": F.lit("mine"), "offset": F.lit(1)}), "value")
    assert clash.columns == [*out.columns, "kind", "offset", "length", "bytes"] and clash.count() == len(cut)
    assert {(r.kind, bytes(r.bytes)) for r in cut} == {("png", png()), ("wav", media.to_wav(b"q"))}


def test_store_and_reread(spark):
    texts = [None, "", "x", "é" * 32, "RIFF BM \x1f", "a" * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = df.withColumn("media", media.store("text")).withColumn("back", media.reread("media")).collect()
    for r in out:
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert bytes(r.back.payload) == payload and r.back.feature.startswith("wav@0+")
        assert hashlib.sha256(bytes(r.media)[44:]).digest() == hashlib.sha256(payload).digest()


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", "é"), (2, 0, "system", "x"), (None, 0, None, None), (3, None, "ann", "a"), (3, 5, "ann", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit(0))
    for block in (1, 2, 256):
        got = chat.rotate(df, block=block).collect()
        by = {}
        for r in got:
            by.setdefault((r.conv_id, r.perspective), []).append(r)
        assert set(by) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "ann")}
        for rs in by.values():
            rs.sort(key=lambda r: r.seg_start)
            whole = "".join(r.segment for r in rs)
            for r in rs:
                assert whole[r.seg_start : r.seg_end] == r.segment
                learnt = whole[r.mask_start : r.mask_end]
                assert (learnt.endswith("<|end|>\n") and r.speaker == r.perspective) or (learnt == "" and r.speaker != r.perspective)
        ann = "".join(r.segment for r in by[(1, "ann")])
        assert ann == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user:bob|>\nyo<|end|>\n<|assistant|>\né<|end|>\n"
    assert chat.rotate(df.limit(0)).count() == 0


def test_template_by_count_on_large_and_small_hosts(spark):
    def page(i, bar, quote):
        return f"<body>{'<div class=x1><span>Follow us everywhere</span></div>' if bar else ''}{'<p>A quoted passage.</p>' if quote else ''}<p>Story {i} of the day.</p></body>"

    rows = [(i, "http://large.example/p", page(i, i < 12, i < 10)) for i in range(200)]  # on 6 and 5 per cent of the pages
    rows += [(1000 + i, "http://small.example/p", page(i, True, True)) for i in range(3)]
    rows += [(2000 + i, "http://two.example/p", page(i, True, False)) for i in range(2)]
    rows += [(3000, "http://same.example/p", page(0, True, False))] * 5  # five copies are one article
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Story 0 of the day." and got[11] == "Story 11 of the day."
    assert got[1001] == "A quoted passage.\n\nStory 1 of the day."
    assert got[2001] == "Follow us everywhere\n\nStory 1 of the day." and got[3000] == "Follow us everywhere\n\nStory 0 of the day."
