import base64
import bz2
import gzip
import hashlib
import lzma
import re
import time
import tracemalloc
import zlib
from itertools import product
from urllib.parse import quote

import zstandard
from pyspark.sql import functions as F

from tessera.llm.secrets import layers, redact, redacted, scan_secrets, secrets_of

KEY = "AKIA" + "ABCDEFGH12345678"


def brute(text):
    out = []
    a = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", 0, *m.span()) for m in re.finditer(a, text) if len(m[2]) >= 8]
    out += [("access", 1, *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", 2, *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for k, _, s, e in sorted(out, key=lambda x: (x[2], x[1], x[3]))]


TEXTS = [
    None, "", "nothing", 'token = "' + "ab12" * 10 + '"', "Password: short", "API_KEY=abcdefgh.-", "apikey:'xyzxyzxyz", KEY,
    "AKIA1", "0" * 31, "0" * 32 + "g" + "f" * 40, "é token=ABCDEFGH1 ü " + KEY, "ſecret=abcdefgh1", "toKen=abcdefgh1", "secret=secret=abcdefgh",
]


def test_base_spans_and_counts(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, KEY, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = scan_secrets(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute((KEY if r["doc_id"] is None else TEXTS[r["doc_id"]]) or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [[k for k, _, _ in want].count(x) for x in ("assign", "access", "hex")]
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(filter(None, r["spans"].split(",")))
    assert scan_secrets(df.limit(0)).count() == 0
    clean = df.select(redacted(F.col("text")).alias("t")).collect()
    assert sum(r["t"] is None for r in clean) == 1 and not any(KEY in (r["t"] or "") for r in clean)


def test_layers_map_back():
    secret = "password=hunter2hunter2"
    b64 = lambda b: base64.b64encode(b).decode()
    for inner in (
        b64(secret.encode()), b64(gzip.compress(secret.encode())), b64(zlib.compress(secret.encode())),
        b64(b64(b"x " + secret.encode() + b" y").encode()), b64(gzip.compress(b64(gzip.compress(secret.encode())).encode())),
        b64(quote(secret, safe="").replace("=", "%3D").encode()),
    ):
        text = f"é before {inner} after"
        base, spans = secrets_of(text)
        assert [k for k, _, _ in spans if k == "assign"], inner
        for k, a, b in spans:
            assert text.index(inner) <= a < b <= text.index(inner) + len(inner)
        assert inner not in redact(text)
    text = "see password%3Dhunter2%68unter2 end"
    assert secrets_of(text) == ([], [("assign", 4, 31)])
    assert secrets_of("see password%253Dhunter2hunter2 end")[1] == [("assign", 4, 31)]
    assert secrets_of(r"see password\x3dhunter2hunter2 end")[1] == [("assign", 4, 30)]
    assert secrets_of("see &#112;assword&#x3D;hunter2hunter2 end")[1] == [("assign", 4, 37)]


def test_layers_end():
    assert len(list(layers("%25" * 50))) == 2
    assert len(list(layers("%2525252525252541"))) < 12
    assert secrets_of("%ff%fe\\ud800 \\u" + "=" * 40 + "A" * 100)[0] == []
    secrets_of("%E2%82%AC\\ud83d\\ude00" * 100 + "a" * 100_000)


def test_wrapped_and_glued_base64():
    secret = b"some text in front, then password=hunter2hunter2 and some text after it"
    one = lambda b: base64.b64encode(b).decode()
    wrap = lambda t, n: "\n".join(t[i : i + n] for i in range(0, len(t), n))
    packed = gzip.compress(bytes(range(256)) + secret)
    for n in (20, 64, 76):
        for run in (wrap(one(secret), n), wrap(one(packed), n).replace("\n", "\r\n")):
            text = f"before {run} after"
            spans = [s for s in secrets_of(text)[1] if s[0] == "assign"]
            assert spans and all(7 <= a < b <= 7 + len(run) for _, a, b in spans)
    for front in ("https://h/a/", "https://h/ab/", "x-", "key_", "abc"):
        for raw in (secret, packed, b"\xff" + secret, secret + b"\xff", bytes(range(200)) + secret):
            assert any(k == "assign" for k, _, _ in secrets_of(f"see {front}{one(raw)} end")[1]), (front, raw)


def test_escaped_bytes_and_members():
    secret = b"password=hunter2hunter2"
    for raw in (gzip.compress(secret), zlib.compress(secret), bz2.compress(secret), gzip.compress(b"first") + gzip.compress(secret)):
        for run in (
            "".join(f"%{b:02X}" for b in raw), "".join(f"\\x{b:02x}" for b in raw), quote(raw, safe=""), repr(raw)[2:-1],
            base64.b64encode(raw).decode(),
        ):
            assert any(k == "assign" for k, _, _ in secrets_of(f"see <{run}> end")[1]), run
    frames = zstandard.compress(b"first") + zstandard.compress(secret)
    assert secrets_of(base64.b64encode(frames).decode())[1]


ENCODERS = {
    "percent": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "quote": lambda t: quote(t, safe=""),
    "x": lambda t: "".join(f"\\x{b:02x}" for b in t.encode()),
    "u": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "entity": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "url64": lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
    "mime": lambda t: base64.encodebytes(t.encode()).decode().strip(),
    **{
        name: lambda t, pack=pack: base64.b64encode(pack(t.encode())).decode()
        for name, pack in {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.compress}.items()
    },
}


def test_any_nesting_is_unwrapped():
    """The layers of a text encoded three times over hold what was encoded, and its span lies in the encoded part."""
    for a, b in product(ENCODERS, repeat=2):
        c = list(ENCODERS)[(len(a) * 7 + len(b)) % len(ENCODERS)]
        inner = ENCODERS[c](ENCODERS[b](ENCODERS[a](f"x, password=hunter2hunter2 {KEY}, y")))
        text = f"é before <{inner}> after"
        spans = secrets_of(text)[1]
        assert {"assign", "access"} <= {k for k, _, _ in spans}, (a, b, c)
        assert all(10 <= s <= e <= 10 + len(inner) for _, s, e in spans), (a, b, c)


def test_chains_of_escaped_escapes_take_one_pass():
    for chain in ("%" + "25" * 200_000 + "41", "\\u005c" + "u005c" * 80_000 + "u0041", "&#38;" + "#38;" * 100_000 + "#65;", "%" * 200_000 + "3341"):
        began = time.monotonic()
        found = [layer.text[:3] for layer in layers("password=hunter2hunter2 " + chain + "bcdefgh")]
        assert len(found) < 8 and time.monotonic() - began < 10
    assert any(layer.text == "A" for layer in layers("%" + "25" * 1000 + "41"))
    text = "%" + "25" * 99 + "70assword=hunter2hunter2"
    assert secrets_of(text)[1] == [("assign", 0, len(text)), ("hex", 1, text.index("ssword"))]


def test_layers_larger_than_a_window():
    data = bytes(range(128, 250)) * 100_000 + b" password=hunter2hunter2 " + bytes(5_000_000)
    text = "see " + base64.b64encode(zlib.compress(data)).decode() + " end"
    spans = secrets_of(text)[1]
    assert any(k == "assign" and 4 <= a < b <= len(text) - 4 for k, a, b in spans)
    big = "plain words " * 200_000 + "password%3Dhunter2hunter2"
    tracemalloc.start()
    assert secrets_of(big)[1] == [("assign", 2_400_000, len(big))]
    assert tracemalloc.get_traced_memory()[1] < 20 * len(big)
    tracemalloc.stop()
