"""Secret scans: base findings against a plain scan, and nested layers."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard

from tests.conftest import SF001
from tickframe.llm import queries
from tickframe.llm import secrets as S

SECRET = "password=hunter2hunter2"


def plain(text):
    got = []
    pat = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    got += [("assign", *m.span()) for m in re.finditer(pat, text, re.I | re.A) if len(m[2]) >= 8]
    got += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    got += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return got


def encodings():
    b = SECRET.encode()
    yield "url", "".join(f"%{x:02x}" for x in b)
    yield "unicode", "".join(f"\\u{x:04x}" for x in b)
    yield "html", "".join(f"&#{x};" for x in b)
    yield "fullwidth", "".join(chr(x + 0xFEE0) for x in b)
    yield "base64", base64.b64encode(b).decode()
    yield "urlsafe", base64.urlsafe_b64encode(b"\xff\xfe?>" + b).decode()
    yield "shifted", "path/" + base64.b64encode(b).decode()
    yield "utf16", base64.b64encode(SECRET.encode("utf-16-le")).decode()
    for name, pack in (("gzip", gzip.compress), ("zlib", zlib.compress), ("bz2", bz2.compress),
                       ("zstd", zstandard.ZstdCompressor().compress)):
        yield name, base64.b64encode(pack(b)).decode()
    yield "nested", urllib.parse.quote(base64.b64encode(gzip.compress(base64.b64encode(b) + b"!")).decode(), safe="")
    yield "wrapped", base64.encodebytes(b"x" * 70 + b" " + b + b" " + b"y" * 30).decode()


@pytest.mark.parametrize("name,coded", list(encodings()))
def test_layers_map_to_the_outer_span(name, coded):
    text = f"some é text ({coded}) and more"
    base, found, layers = S.find(text)
    assert layers >= 1
    hits = [f for f in found if f[0] == "assign"]
    assert hits, found
    at = text.index(coded)
    assert all(at <= s < e <= at + len(coded.rstrip()) + 1 for _, s, e, *_ in hits)


def test_cycles_and_nesting_end():
    coded = SECRET
    for k in range(12):
        coded = base64.b64encode(coded.encode()).decode() if k % 2 else urllib.parse.quote(coded, safe="").replace("h", "%68")
    _, found, _ = S.find(coded + " %2525252525 \\u005cu005c")
    assert any(f[0] == "assign" for f in found)


def test_ascii_letters_only():
    assert S.scan("to\u212aen=abcdefghij pa\u017f\u017fword=abcdefghij") == []
    assert S.scan("TOKEN = 'abcdefgh")[0] == ("assign", 0, 17)
    assert S.scan("token=short password=longenough1") == [("assign", 12, 32)]


def test_query_matches_plain_scan(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op1_secrets"](spark, SF001).collect()}
    assert len(got) == len(docs)
    for d in docs:
        base = plain(d.text)
        r = got[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[0] == k for b in base) for k in S.KINDS)
        assert r.base_sha256 == hashlib.sha256(S.joined(base).encode()).hexdigest()
        assert set(S.joined(base).split(",")) - {""} <= set(r.spans.split(","))


def test_odd_rows_and_redaction(spark):
    coded = base64.b64encode(SECRET.encode()).decode()
    rows = [(1, None, "x", 3), (2, "", None, 0), (3, f"é {SECRET}, {coded}", "y", 9), (3, f"é {SECRET}, {coded}", "y", 9),
            (4, "a" * 300000, "z", 1), (None, "AKIA" + "B" * 12, "w", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    out = [r.asDict() for r in S.redacted(docs).collect()]
    assert [r["text"] for r in out[:2]] == [None, ""]
    assert out[2] == out[3] == {"doc_id": 3, "text": "é [SECRET], [SECRET]", "spans": "y", "n_chars": 20}
    assert out[5]["text"] == "[SECRET]"
    assert S.secrets(docs.limit(0)).count() == 0


PACKS = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress,
         "zstd": zstandard.ZstdCompressor().compress}


@pytest.mark.parametrize("name", PACKS)
def test_packed_data_at_any_offset(name):
    b = PACKS[name](b"key " + base64.b64encode(b"... " + SECRET.encode()))
    for coded in ("path/to/" + base64.b64encode(b).decode(), "data-" + base64.urlsafe_b64encode(b).decode(),
                  urllib.parse.quote(b), "".join(f"\\x{x:02x}" for x in b), "".join(f"%{x:02x}" for x in b),
                  base64.b64encode(PACKS[name](b"a first member") + b).decode(),
                  base64.b64encode(gzip.compress(b"head " + b + b" tail")).decode()):
        text = f"some é text ({coded}) and more"
        _, found, _ = S.find(text)
        at = text.index(coded)
        hits = [f for f in found if f[0] == "assign"]
        assert hits and all(at <= s < e <= at + len(coded) for _, s, e, *_ in hits), (coded, found)


def test_a_run_that_a_window_cuts_is_carried(monkeypatch):
    monkeypatch.setattr(S, "WINDOW", 4096)
    monkeypatch.setattr(S, "OVERLAP", 256)
    noise = random.Random(1).randbytes(9000)
    inner = gzip.compress(noise + b" " + SECRET.encode())
    for coded in (base64.b64encode(inner), urllib.parse.quote(inner).encode(), inner):
        _, found, _ = S.find(base64.b64encode(gzip.compress(b"words " * 500 + coded + b" more words" * 500)).decode())
        assert any(f[0] == "assign" for f in found)


def test_a_stream_that_unpacks_to_itself_ends(monkeypatch):
    monkeypatch.setattr(S, "decompressed", lambda data, *_: [(0, len(data), data)])
    assert S.find(base64.b64encode(gzip.compress(b"x" * 99)).decode())[2] < 9


def fullwidth(text):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)


def escaped(data):
    return "".join(f"\\x{x:02x}" for x in data)


#: From text to text; all but the first four by way of bytes.
KINDS = {
    "fullwidth": fullwidth, "html": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "u4": lambda t: "".join(f"\\u{ord(c):04x}" for c in t), "x": lambda t: escaped(t.encode()),
    "url": lambda t: "".join(f"%{x:02X}" for x in t.encode()), "quote": lambda t: urllib.parse.quote(t, safe=""),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "le": lambda t: base64.b64encode(t.encode("utf-16-le")).decode(),
    "be": lambda t: base64.b64encode(t.encode("utf-16-be")).decode(),
    "url_be": lambda t: urllib.parse.quote(t.encode("utf-16-be")),
    "x_le": lambda t: escaped(t.encode("utf-16-le")),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
    "url_zlib": lambda t: urllib.parse.quote(zlib.compress(t.encode())),
    "x_bz2": lambda t: escaped(bz2.compress(t.encode())),
    "js_zstd": lambda t: urllib.parse.quote(zstandard.ZstdCompressor().compress(t.encode()).decode("latin-1")),
    "u_xz": lambda t: "".join(f"\\u{x:04x}" for x in lzma.compress(t.encode())),
}


@pytest.mark.parametrize("outer", KINDS)
@pytest.mark.parametrize("inner", KINDS)
def test_every_pair_of_layer_kinds(inner, outer):
    coded = KINDS[outer](KINDS[inner](SECRET))
    text = f"some é text ({coded}) and more"
    _, found, _ = S.find(text)
    at = text.index(coded)
    spans = [(s, e) for k, s, e, *_ in found if k == "assign"]
    assert any(at <= s < e <= at + len(coded) for s, e in spans), (coded, found)


@pytest.mark.parametrize("code", ["utf-16-le", "utf-16-be"])
@pytest.mark.parametrize("secret", ["token=abcdefgh", SECRET])
def test_utf16_keeps_all_characters(code, secret):
    for coded in (base64.b64encode(secret.encode(code)).decode(), "".join(f"%{x:02x}" for x in secret.encode(code))):
        text = f"({coded})"
        spans = {(s, e) for k, s, e, *_ in S.find(text)[1] if k == "assign"}
        assert (1, 1 + len(coded)) in spans and (min(spans)[0], max(e for _, e in spans)) == (1, 1 + len(coded))


def test_characters_of_several_bytes_map_to_their_bytes():
    text = "%C3%A9 %E2%82%AC " + urllib.parse.quote(fullwidth("token=abcdefgh")) + " %FF"
    assert [f[:3] for f in S.find(text)[1]] == [("assign", 17, 17 + 9 * 14)]


@pytest.mark.parametrize("quote", [urllib.parse.quote, escaped, lambda b: "".join(f"%{x:02x}" for x in b)])
def test_a_member_cut_off_ends_with_its_run(quote):
    coded = quote(zlib.compress(b"%s " % SECRET.encode() + random.Random(2).randbytes(2000))[:1500])
    text = f"text ({coded}) and more " + "words " * 500
    spans = [(s, e) for k, s, e, *_ in S.find(text)[1] if k == "assign"]
    assert spans and all(6 <= s < e <= 6 + len(coded) for s, e in spans)
