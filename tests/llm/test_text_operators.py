"""Byte-level BPE, secrets, personal data, decontamination, HTML: against brute force or another library."""

import base64
import hashlib
import json
import random
import re
import struct
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, html, pii, secrets

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n \t", "a", "\x00\x01", "é" * 300, "日本語 テスト 👩‍👩‍👧", "<|endoftext|> <unk> ▁x", "ab" * 20_000, "  don't  stop  ", "AKIA" * 50]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bpe_is_tiktokens(spark, clashing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [*ODD, *ODD, *("".join(rng.choice("abc é\n'12日,.") for _ in range(rng.randrange(400))) for _ in range(60))]
    df = bpe.decode(bpe.encode(clashing(frame(spark, texts), "decoded", "IDS"), PATH, public_tokenizers.PATTERN), PATH)
    rows = sorted(df.collect(), key=lambda r: r["doc_id"])
    assert len(rows) == len(texts)
    for r, x in zip(rows, texts, strict=True):
        assert list(r["ids"]) == other.encode_ordinary(x or "")
        assert bytes(r["decoded"]) == (x or "").encode()
    got = bpe.with_digests(df.select("doc_id", "ids", "decoded")).where("doc_id = 4").first()
    assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, other.encode_ordinary("a"))).encode()).hexdigest()
    assert bpe.decode(bpe.encode(frame(spark, []), PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_pieces_decode_as_the_ranks_do():
    """The model's pieces, mapped back to bytes, are the rank list: for every id."""
    encoder, decoder = bpe.Encoder(PATH, public_tokenizers.PATTERN), bpe.Decoder(PATH)
    back = {c: b for b, c in enumerate(bpe.ALPHABET)}
    n = len(decoder.vocabulary)
    assert encoder.model.get_piece_size() == n + 1
    assert [bytes(back[c] for c in encoder.model.id_to_piece(i)) for i in range(n)] == decoder.vocabulary


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    text = " ".join(f"w{i}" for i in range(400))
    assert bpe.Decoder(PATH).decode(encoder.encode(text)) == text.encode()
    ranks = bpe.read_ranks(PATH)
    assert ranks[encoder.encode("a")[0]] == b"a"


# Secrets.

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(x):
    x = x or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 32]


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([128 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def integer(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def rsa_key():
    p, q = 2**521 - 1, 2**607 - 1
    return der(0x30, b"".join(map(integer, (0, p * q, 65537, 1234567, p, q, 5, 7, 11))))


def openssh_key():
    s = lambda b: struct.pack(">I", len(b)) + b
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + struct.pack(">I", 1) + s(b"public part") + s(b"private part" * 4)


def jwt(header, payload):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    return f"{part(header)}.{part(payload)}.c2lnbmF0dXJlLXNpZ25hdHVyZQ"


def test_secret_structures():
    rsa, ssh = rsa_key(), openssh_key()
    wrapped = der(0x30, integer(0) + der(0x30, der(6, bytes.fromhex("2a864886f70d010101")) + der(5, b"")) + der(4, rsa))
    ec = der(0x30, integer(1) + der(4, b"k" * 32) + der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))))
    for data, kind in ((rsa, "der_key"), (wrapped, "der_key"), (ec, "der_key"), (ssh, "openssh_key"), (b"here: password = correcthorse99", "encoded_secret"), (base64.b64encode(b"secret: abcdefgh12345"), "encoded_secret")):
        for run in (base64.b64encode(data).decode(), data.hex().upper()):
            text = f"é {run} z"
            assert (kind, 2, 2 + len(run)) in secrets.secret_spans(text), (kind, run[:20])
    for broken in (rsa[:-1], rsa + b"x", rsa[:5] + b"\x00" + rsa[6:], ssh[:-2], bytes(random.Random(1).randbytes(300))):
        assert not [s for s in secrets.secret_spans(base64.b64encode(broken).decode()) if s[0] not in secrets.BASE]
    token = jwt({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})
    assert secrets.secret_spans(f"({token})") == [("signed_token", 1, 1 + len(token))]
    assert not secrets.secret_spans(jwt({"typ": "JWT"}, {"sub": "1"})) and not secrets.secret_spans(token.replace(".", ".x", 1))
    lines = re.sub("(.{64})", r"\1\n", base64.b64encode(rsa).decode())
    armour = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    assert secrets.secret_spans("x" + armour) == [("armoured_key", 1, 1 + len(armour))]


def found(text):
    """What is found beyond the base patterns, with its text."""
    return [(k, text[a:b]) for k, a, b in secrets.secret_spans(text) if k not in secrets.BASE]


def test_secrets_encoded_many_times():
    run = "password = correcthorse99"
    for _ in range(7):
        run = base64.b64encode(run.encode()).decode()
        assert found(f"x {run} y") == [("encoded_secret", run)]
    assert not found("x " + base64.b64encode(base64.b64encode(b"nothing to be seen in here at all")).decode())


def encrypted_token(header, sizes):
    part = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    return ".".join([part(json.dumps(header).encode()), *(part(bytes(random.Random(n).randbytes(n))) for n in sizes)])


def test_encrypted_tokens_are_whole():
    token = encrypted_token({"alg": "RSA-OAEP", "enc": "A256GCM"}, (256, 12, 40, 16))
    assert found(f"({token})") == [("encrypted_token", token)] and secrets.masked(f"a {token} b") == "a [secret] b"
    agreed = encrypted_token({"alg": "dir", "enc": "A128CBC-HS256"}, (0, 16, 48, 16))
    assert found(agreed + ".") == [("encrypted_token", agreed)]
    for header, sizes in (({"alg": "x", "enc": 1}, (256, 12, 40, 16)), ({"alg": "RSA-OAEP", "enc": "A256GCM"}, (0, 12, 40, 16)), ({"alg": "dir", "enc": "A256GCM"}, (0, 11, 40, 16)), ({"alg": "dir", "enc": "A256GCM"}, (0, 12, 40, 15))):
        assert not found(encrypted_token(header, sizes)), (header, sizes)
    assert not found(base64.urlsafe_b64encode(b'{"alg":"x","enc":1}').decode().rstrip("=") + ".a.")
    signed = jwt({"alg": "HS256"}, {"a": 1})
    assert found(f"{signed}.more.text") == [("signed_token", signed)]


def test_keys_in_other_clothes():
    rsa, ssh = rsa_key(), openssh_key()
    body = base64.b64encode(rsa).decode()
    lines = re.sub("(.{64})", r"\1\n", body)
    # Armour in a string, with literal line ends.
    quoted = "-----BEGIN RSA PRIVATE KEY-----\\n" + lines.replace("\n", "\\n") + "\\n-----END RSA PRIVATE KEY-----"
    assert found(f'key = "{quoted}"') == [("armoured_key", quoted)]
    # Header lines and an encrypted body.
    blob = base64.b64encode(bytes(random.Random(3).randbytes(160))).decode()
    for start, ok in (("00" * 16, True), ("00" * 8, True), ("zz" * 8, False), ("00" * 7, False)):
        armour = f"-----BEGIN EC PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{start}\n\n{blob}\n-----END EC PRIVATE KEY-----"
        assert (found(armour) == [("armoured_key", armour)]) == ok
    # An encrypted key by its object id; a digest has the same elements and is none.
    for name, ok in (("2a864886f70d01050d", True), ("2a864886f70d010c0103", True), ("608648016503040201", False)):
        data = der(0x30, der(0x30, der(6, bytes.fromhex(name)) + der(5, b"")) + der(4, b"x" * 64))
        run = base64.b64encode(data).decode()
        assert (found(run) == [("der_key", run)]) == ok
    # Wrapped over lines, without armour; what follows isn't part of it.
    for data, kind in ((rsa, "der_key"), (ssh, "openssh_key")):
        for width in (64, 76):
            wrapped = "\n".join(re.findall(f".{{1,{width}}}", base64.b64encode(data).decode()))
            assert found(f"the key:\n{wrapped}\n\nand more") == [(kind, wrapped)]
    after = "\n".join(re.findall(".{1,64}", body)) + "\n" + "A" * 64
    assert found(after) == [("der_key", after[:-65])] or len(body) % 64
    assert not found("\n".join(re.findall(".{1,64}", base64.b64encode(rsa[:-9]).decode())))


def test_secrets_take_time_in_proportion():
    token = jwt({"alg": "HS256"}, {"sub": "1"})
    took = []
    for n in (2_000, 8_000):
        began = time.process_time()
        assert len(found(f"{token} " * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]
    secrets.secret_spans("-----BEGIN PRIVATE KEY-----" * 20_000)
    secrets.secret_spans("eyJ." * 50_000)


def test_secrets_match_brute_force(spark, clashing):
    rng = random.Random(5)
    bits = ["token", "API_KEY", "apikey", "ſecret", "toKen", " = ", ":", '"', "abcdefgh", "deadbeef" * 4, "AKIA", "ABCDEFGH12345678", "\n", "é", "==", "password", "passwd", "secret", " "]
    texts = [*ODD, *("".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400))]
    df = clashing(frame(spark, texts), "secrets", "kind", "n_hex", "SPANS")
    digests = secrets.with_digests(secrets.find_secrets(df).drop("text"), "secrets", secrets.BASE)
    assert digests.columns == ["doc_id", "kind", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"]
    rows = sorted(digests.collect(), key=lambda r: r["doc_id"])
    order = {"assign": 0, "access": 1, "hex": 2}
    for r, x in zip(rows, texts, strict=True):
        want = sorted(base_secrets(x), key=lambda s: (s[1], order[s[0]]))
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == y for k, _, _ in want) for y in order]
        assert set(spelled.split(",")) - {""} <= set(r["spans"].split(","))
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(df).collect()}
    assert masked[0] is None and masked[1] == "" and "deadbeef" * 4 not in "".join(x or "" for x in masked.values())


# Personal data.


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_personal(x):
    x = x or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m[0])) <= 15]


def test_personal_matches_brute_force(spark):
    rng = random.Random(6)
    bits = ["a", "b.c", "@", "@x.de", "1", "12", "255", "256", ".", "-", " ", "+1", "(017) ", "555-1234", "4111 1111 1111 1111", "4111111111111111", "é", "\n", "010.0.0.1", "%", "_", "٣"]
    texts = [*ODD, *("".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(500))]
    rows = sorted(secrets.with_digests(pii.find_personal(frame(spark, texts)).drop("text"), "personal", pii.BASE).collect(), key=lambda r: r["doc_id"])
    for r, x in zip(rows, texts, strict=True):
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in base_personal(x))
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(spelled.split(",")) - {""} <= set(r["spans"].split(","))


def test_field_finds_what_patterns_miss():
    field, rng = pii.trained(), random.Random(77)
    right = wanted = given = 0
    for _ in range(200):
        text, gold = pii.sentence(rng)
        gold = {(a, b, pii.TYPES[y]) for a, b, y in gold}
        found = {(a, b, k) for k, a, b in pii.field_spans(text, field)}
        right, wanted, given = right + len(gold & found), wanted + len(gold), given + len(found)
    assert right / wanted > 0.95 and right / given > 0.95
    spans = pii.personal_spans("my ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00, call (017) 555-7713. total 1,234.50", field)
    assert {k for k, _, _ in spans} >= {"national_id", "iban", "phone_span"}
    assert pii.personal_spans("nothing here", field) == []
    pii.personal_spans("1" * 30_000 + "@" * 3000, field)
    ids = " ".join(f"ssn 123-45-{i:04d}," for i in range(1, 700))
    assert sum(k == "national_id" for k, _, _ in pii.personal_spans(ids, field)) > 690


@pytest.mark.parametrize("text, want", [
    ("write to name @ mail.dept.uni.example.edu now", [("email_span", "name @ mail.dept.uni.example.edu")]),
    ("ask name.of.the.person.who.leads.the.whole.firm @ example.com.", [("email_span", "name.of.the.person.who.leads.the.whole.firm @ example.com")]),
    ("host fe80::1ff:fe23:4567:890a is up", [("ip_span", "fe80::1ff:fe23:4567:890a")]),
    ("passport L01X00T47, or DE44500105175407324932", []),
    ("account DE44500105175407324931.", [("iban", "DE44500105175407324931")]),
    ("x " * 5000 + "ssn 123-45-6789", [("national_id", "123-45-6789")]),
])
def test_field_finds_whole_spans(text, want):
    got = pii.personal_spans(text, pii.trained())
    assert [(k, text[a:b]) for k, a, b in got if k not in pii.BASE and k != "phone_span"] == want


def slow_decode(text, field):
    """The best segmentation over all tokens and all candidates, by plain dynamic programming."""
    tokens = [(m[0], m.start(), m.end()) for m in pii.TOKEN.finditer(text)]
    ends = {}
    for i, j, f, able in field.lattice(text, tokens):
        for y, s in enumerate((field.w[f].sum(0) + able).tolist()):
            ends.setdefault(j, []).append((i, y, s))
    n, out = len(tokens), pii.OUTSIDE
    best = [{out: (0.0, ())}]
    for j in range(1, n + 1):
        now = {}
        for i, y, s in [(j - 1, out, 0.0), *ends.get(j, ())]:
            for before, (value, path) in best[i].items():
                total = value + s + float(field.step[before, y])
                if total > now.get(y, (float("-inf"),))[0]:
                    now[y] = (total, path if y == out else (*path, (tokens[i][1], tokens[j - 1][2], y)))
        best.append(now)
    return max(best[n].values(), key=lambda x: x[0])


def test_decoding_matches_brute_force():
    rng, trained = random.Random(9), pii.trained()
    bits = ["12", "1", "555", "4111", "255", "0", ".", "-", " ", " ", "(", ")", "+", "a", "tel ", "ssn ", "@", "x.y", ".com", "fe80", "::", ":", "DE89 3704 0044 0532 0130 00", "123-45-6789", "\n", "é", ", ", "1234567"]
    for k in range(250):
        field = trained
        if k % 2:  # any weights: entities side by side and odd steps
            field = pii.Field()
            field.names, noise = dict(trained.names), np.random.default_rng(k)
            field.w, field.step = noise.normal(0, 1, trained.w.shape), noise.normal(0, 1, trained.step.shape)
            field.step[pii.OUTSIDE, pii.OUTSIDE] = 0
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        value, want = slow_decode(text, field)
        segments = field.segments(text)
        got = field.decode(text, segments)
        scores, kinds = {x[:3]: x[3] for x in segments}, []
        tokens = [m.span() for m in pii.TOKEN.finditer(text)]
        for a, b in tokens:
            inside = [g for g in got if g[0] <= a and b <= g[1]]
            if not inside or a == inside[0][0]:
                kinds.append(inside[0][2] if inside else pii.OUTSIDE)
        total = sum(scores[g] for g in got) + sum(float(field.step[x, y]) for x, y in zip([pii.OUTSIDE, *kinds], kinds, strict=False))
        assert abs(total - value) < 1e-6 and (k % 2 or tuple(got) == want), text


def test_field_decodes_digits_fast():
    """A bound far below what is measured (README), against quadratic work."""
    field, rng = pii.trained(), random.Random(4)
    text = "".join("".join(rng.choices("0123456789", k=4)) + " " for _ in range(20_000))
    began = time.process_time()
    pii.field_spans(text, field)
    assert len(text) / (time.process_time() - began) > 30_000


# Decontamination.


def words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def brute_overlap(docs, items):
    out = []
    for x in docs:
        d, hit, keys = words(x), set(), set()
        for key, text in items:
            w = words(text)
            n = min(13, len(w))
            if not n:
                continue
            for win in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}:
                for i in range(len(d) - n + 1):
                    if tuple(d[i : i + n]) == win:
                        hit |= set(range(i, i + n))
                        keys |= set() if key is None else {str(key)}
        out.append((len(d), len(hit), len(keys), hashlib.sha256(",".join(sorted(keys)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(d)))
    return out


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_overlap_matches_brute_force(spark, clashing, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MAP_BITS", bits)
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice("the of a Élan x1 b c d".split()) for _ in range(n))
    items = [(i, line(rng.choice([1, 5, 12, 13, 14, 30]))) for i in range(14)] + [(3, "the of a"), (20, None), (21, "--"), (None, "a b c"), (1, line(40))]
    docs = [*ODD, "the OF a", *(line(rng.randrange(60)) for _ in range(80))]
    docs += [line(10) + "; " + (items[rng.randrange(14)][1] or "") + "! " + line(rng.choice([3, 300])) for _ in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs += docs[-30:] * 2
    found = decontaminate.with_verdict(decontaminate.find_overlap(clashing(frame(spark, docs), "n_words", "shingle", "k1", "h", "HITS"), bench))
    assert found.columns[:5] == ["doc_id", "text", "shingle", "k1", "h"]
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    got = [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows]
    assert got == brute_overlap(docs, items)


def test_overlap_without_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.with_verdict(decontaminate.find_overlap(frame(spark, ["a b"]), bench)).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in rows] == [(2, 0, False)]


# HTML.

PAGE = """<title>x</title><style>.h{display:none} p{margin:0}</style><h1>A  b</h1><p>one<p>two<br>three &amp; four<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li><p>y<p>z</ol>
<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td rowspan=2>r<td>1<tr><td>2</table><div class=h>no</div><div hidden>no</div><i style="color:red;display:none">no</i>
<pre>
 keep
   this</pre><script>var t="</p>"</script><details><summary>S</summary>no</details>1 < 2 <trunc"""

TEXT = """A b

one

two
three & four

- a
- b
  - c

3. x

4. y

   z

Name       N
long name  1
r          1
           2

 keep
   this

S
1 < 2"""


def test_html_layout(spark):
    assert html.visible_text(PAGE) == TEXT
    rows = [(1, PAGE), (2, None), (3, ""), (4, "plain"), (5, "<div>" * 20_000 + "deep"), (6, "<table><tr><td>" * 500 + "cell"), (1, PAGE), (7, "<p" + " a" * 5000), (8, "<b>x</i></b></p>y")]
    got = [r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()]
    assert got == [TEXT, "", "", "plain", "deep", "cell", TEXT, "", "x\n\ny"]
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).columns == ["page_id", "html", "text"]


def columns_on_screen(line):
    import unicodedata

    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in line)


def test_table_columns_begin_at_one_place():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(2, 6)
        starts, rows, k = {}, [], 0
        for _ in range(rng.randrange(2, 8)):
            cells, c = [], 0
            while c < n:
                across = rng.choice([1, 1, 1, 2, 3])
                size = rng.choice([1, 3, 12, 100, 300])
                words = " ".join([f"c{c}q{k}z", *(["wide字" * rng.randrange(1, 3), "e\u0301x", "w" * min(size, 90)] * (size // 40))])
                cells.append(f"<td colspan={across}>{words}</td>" if rng.random() < 0.9 else f"<td colspan={across}></td>")
                c, k = c + across, k + 1
            rows.append("<tr>" + "".join(cells))
        for line in html.visible_text("<table>" + "".join(rows) + "</table>").split("\n"):
            for m in re.finditer(r"c(\d)q\d+z", line):
                starts.setdefault(m[1], set()).add(columns_on_screen(line[: m.start()]))
        assert all(len(x) == 1 for x in starts.values()), starts


@pytest.mark.parametrize("page, want", [
    ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><text>chart <tspan>label</tspan></text></svg>", "chart label"),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "so x=2"),
    ("<object data=x><p>instead</object>", "instead"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
    ("<div style='display:none'>no <b style='display:block;visibility:visible'>no</b></div>y", "y"),
    ("<style>div .n{display:none} ul > li.x{display:none}</style><div><p><i class=n>no</i>a</div><i class=n>b</i><ul><li class=x>no<li>c</ul>", "a\n\nb\n\n- c"),
    ("<style>.a{display:none} .a.b{display:block} #k{visibility:hidden!important}</style><p class=a>no<p class='b a'>yes<p id=k style='visibility:visible'>no", "yes"),
    ("<style>@media print{p{display:none}} @media screen{b{display:none}} @font-face{x:y} i[data-x='1']{display:none}</style><p>a<b>no</b><i data-x=1>no</i><i data-x=2>c</i>", "ac"),
    ("<style>p:hover{display:none} a, .q { color: red; display : none }</style><p>a<a>no</a><u class=q>no</u>", "a"),
    ("<p hidden style='display:block'>yes<p hidden>no", "yes"),
    ("<table><tr><td>" + "w" * 100 + "<td>b<tr><td>c<td>d</table>", "w" * 100 + "  b\nc" + " " * 101 + "d"),
    ("<table><tr><td colspan=2>a long spanning cell<td>c<tr><td>1<td>2<td>3</table>", "a long spanning cell  c\n1  2                  3"),
    ("<table><tr><td>字字<td>x<tr><td>abcd<td>y</table>", "字字  x\nabcd  y"),
    ("<table><tr><td>" + "word " * 20 + "<td>x</table>", "word " * 15 + "word  x\n" + "word word word word"),
])
def test_html_shows_what_is_visible(page, want):
    assert html.visible_text(page) == want


def test_html_takes_time_in_proportion():
    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        html.visible_text("<style>div div div b{display:none}</style>" + "<div>" * n + "<b>x" + "<ul><li>y" * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_html_keeps_every_visible_word():
    rng = random.Random(2)
    for _ in range(50):
        seen, out = [], []
        for i in range(60):
            tag = rng.choice(["p", "div", "li", "td", "b", "h2", "blockquote", "span", "tr", "ul", "table", "dd"])
            out.append(f"<{tag}>" if rng.random() < 0.6 else f"</{tag}>")
            if rng.random() < 0.7:
                seen.append(f"w{i}x")
                out.append(f"w{i}x ")
        assert sorted(re.findall(r"w\d+x", html.visible_text("".join(out)))) == sorted(seen)


def test_digest_columns_of_empty_tables(spark):
    df = frame(spark, []).withColumn("extra", F.lit(1))
    assert secrets.with_digests(secrets.find_secrets(df).drop("text"), "secrets", secrets.BASE).count() == 0
    assert pii.find_personal(df).count() == 0
