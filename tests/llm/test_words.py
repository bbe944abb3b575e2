"""Spelling variants, aligned tokenizers and secrets against brute force and held-out samples."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from noticewright.llm import alignment, secret_scan, spelling

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
CLASHING = ["word", "n", "form", "root", "run", "id", "h", "at", "row", "pairs", "value", "label", "kind", "start", "end", "rank", "key"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(rows):
    n = brute_words(rows)
    out = {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = (form, n[w], len(near), n[form] if form else None)
    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {(w, f, root(w), k, m, g) for w, (f, k, m, g) in out.items()}


def variant_rows(rng, n):
    base = ["".join(rng.choices("abcé", k=rng.randint(7, 10))) for _ in range(12)] + ["aaaaaaaaa", "abababababab", "ÿ" * 40, "ab" * 300]
    def changed(w):
        i, kind = rng.randrange(len(w)), rng.random()
        return w[:i] + rng.choice("abcéx") + w[i + (kind < 0.4) :] if kind < 0.7 else w[:i] + w[i + 1 :]
    pool = base + [changed(w) for w in base for _ in range(12)]
    pool += [changed(w) for w in pool]
    weights = [200 if w in base else rng.choice((1, 1, 8, 30)) for w in pool]
    texts = [rng.choice((" ", ", ", "-1")).join(rng.choice((str, str.title, str.upper))(w) for w in rng.choices(pool, weights, k=120)) for _ in range(n)]
    return list(enumerate(texts)) + [(None, texts[0]), (5, texts[5]), (5, None), (7, "")]


@pytest.mark.parametrize("seed", [0, 1])
def test_spelling(spark, seed):
    rows = variant_rows(random.Random(seed), 60)
    want = brute_variants(rows)
    assert sum(1 for w in want if w[1]) > 20 and any(w[2] != w[1] for w in want if w[1])
    got = spelling.spelling_variants(frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert spelling.spelling_variants(frame(spark, [])).count() == 0


def test_pivots():
    order = {g: (i, 10 * i + 1) for i, g in enumerate(["ab", "bc", "cd", "de", "ef", "fg"])}
    assert spelling.prefix_and_pivots("abcdefg", order) == (2 << 32 | 2, [0, 1, 2], 0, 2)
    last, prefix, first, second = spelling.prefix_and_pivots("aaaaaaa", {"aa": (0, 6)})
    assert (last, prefix, first, second) == (2, [0, 1, 2, 3], 0, 2)


ODD = ["", " ", "word", "Hello,", "it's", "don't.", "a\tb", "x \n\n  y", "tab\t", "end\r", "){\r\n", "<|endoftext|>", "<s>", "<0x41>", "▁x", "1234567", "é́", "日本語", " ", "\x1c", "\x85", "😀", "e.g.", "www.a.com", "...", ",,", "--", "×.", "ß,", "　", "x" * 300, "\x00"]


def odd_texts(rng, n):
    return ["".join(rng.choice(ODD) + rng.choice((" ", " ", "", "\n", "  ", ", ")) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def brute_alignment(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = alignment._byte_letters()
    found = []
    for i, t in rows:
        ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        if t:
            ids_a = a.encode(" " + t, add_special_tokens=False).ids
            bytes_a = [bytes(byte_of[c] for c in a.id_to_token(x)) if x != 50256 else b"<|endoftext|>" for x in ids_a]
            ids_b = b.encode(t)
            bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
            if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        links = [(x, y) for x, e, s in zip(ids_a, ends_a, bytes_a, strict=True) for y, f, r in zip(ids_b, ends_b, bytes_b, strict=True) if e - len(s) < f and f - len(r) < e]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [(",".join(str(x) for x, e in zip(ids_a, ends_a, strict=True) if lo < e <= hi), ",".join(str(x) for x, e in zip(ids_b, ends_b, strict=True) if lo < e <= hi)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        text = ";".join(f"{x}|{y}" for x, y in groups)
        found.append((i, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if ids_a else ""))
    count = Counter(p for *_, links, _ in found for p in set(links))
    top = Counter()
    for (x, _), c in count.items():
        top[x] = max(top[x], c)
    return [(i, na, nb, ng, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), d) for i, na, nb, ng, links, d in found]


@pytest.mark.parametrize("sent", [alignment.SENT_PAIRS, 20])
def test_alignment(spark, sent):
    rng = random.Random(3)
    texts = odd_texts(rng, 150)
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (9, None), (10, ""), (11, " "), (12, "The quick brown fox, jumped. Über ño\n" * 40)]
    got = alignment.alignment(frame(spark, rows), sent=sent).collect()
    assert Counter(map(tuple, got)) == Counter(brute_alignment(rows))
    assert alignment.alignment(frame(spark, []), sent=sent).count() == 0


def test_chunks_are_tokenized_as_whole_texts():
    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    letters = "abcdeé .,\n\t'\"1-)\r <|>▁　\x1f×日" + "    e"
    rng = random.Random(11)
    for n in range(6000):
        text = " " + ("".join(rng.choices(letters, k=rng.randint(1, 25))) if n % 3 else odd_texts(rng, 1)[0])
        (parts,), (whole,) = aligner.chunks([text]), [aligner.whole(text)]
        if whole is None:
            assert None in parts, repr(text)
        else:
            assert None not in parts and (sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts), ";".join(p[3] for p in parts), b"".join(p[4] for p in parts)) == whole, repr(text)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_base(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    spans.sort()
    return [(k, a, b) for a, _, k, b in spans]


def secret_texts(rng, n):
    hexa, plain = (lambda k: "".join(rng.choices("0123456789abcdef", k=k))), (lambda k: "".join(rng.choices(string.ascii_letters + string.digits, k=k)))
    parts = [
        lambda: f'token = "{hexa(40)}"', lambda: "PassWord:" + plain(rng.randint(5, 12)), lambda: "password=secret:abcdefghij", lambda: "api_key='" + plain(20) + "'", lambda: "APIKEY : x.y=z-" + plain(4),
        lambda: "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=rng.randint(9, 18))), lambda: "AKIAAKIA", lambda: hexa(rng.choice((31, 32, 33, 64))), lambda: "é" * 3, lambda: "toKen=abcdefgh", lambda: "ſecret=abcdefgh",
        lambda: "secret", lambda: ":=", lambda: "\n", lambda: "mytoken=" + plain(16), lambda: "x" * 16 + "token: 'abcdefgh12'", lambda: "words of a sentence", lambda: "token\"= " + plain(9), lambda: "-" * 40, lambda: "😀" + plain(3),
    ]
    return [rng.choice((" ", "", "\n")).join(rng.choice(parts)() for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_secret_base_spans(spark):
    rng = random.Random(2)
    rows = list(enumerate(secret_texts(rng, 200))) + [(None, 'token = "abcdefgh1"'), (3, None), (4, ""), (5, "ab " * 100_000 + "0" * 32), (6, ("0" * 32 + " ") * 3000)]
    rows += [(0, rows[0][1])]
    docs = frame(spark, rows)
    got = secret_scan.scan(docs, secret_scan.model_of(docs)).collect()
    assert len(got) == len(rows)
    left = Counter(i for i, _ in rows)
    want = {}
    for i, t in rows:
        base = brute_base(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want.setdefault(i, set()).add((*(sum(k == x for x, *_ in base) for k in ("assign", "access", "hex")), digest))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        left[r["doc_id"]] -= 1
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) in want[r["doc_id"]]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        base = [s for s in spans if s[0] != "random"]
        assert spans == sorted(spans, key=lambda s: (s[1], [*secret_scan.BASE, "random"].index(s[0])))
        assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest() == r["base_sha256"]
        for k, a, b in spans:
            if k == "random":
                assert any(re.fullmatch(r"[A-Za-z0-9+/_=-]{16,}", t[a:b]) and not re.match(r"[A-Za-z0-9+/_=-]", t[b:]) for t in texts[r["doc_id"]])
                assert all(y <= a or x >= b for _, x, y in base)
    assert not any(left.values())
    assert secret_scan.scan(frame(spark, []), secret_scan.model_of(frame(spark, []))).count() == 0


def test_random_strings_are_told_from_identifiers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = secret_scan.model_of(docs)
    rng = random.Random(17)
    alphabets = [string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits]
    random_ = ["".join(rng.choices(a, k=24)) for a in alphabets for _ in range(200)]
    words = sorted({w for (t,) in docs.select("text").collect() for w in re.findall("[A-Za-z]{4,}", t or "")})
    pick = lambda: rng.choice(words)
    styles = [lambda: f"{pick()}_{pick()}_{pick()}_{pick()}", lambda: "".join(pick().title() for _ in range(4)), lambda: "-".join(pick() for _ in range(4)), lambda: "/".join(pick() for _ in range(4)), lambda: "_".join(pick().upper() for _ in range(4)), lambda: "".join(pick() for _ in range(3)), lambda: "".join(rng.choices(string.digits, k=16)), lambda: rng.choice("-=_+/") * rng.randint(16, 90)]
    ordinary = [x for s in styles for x in (s() for _ in range(200)) if len(x) >= 16]
    score = lambda xs: [r["r"] for r in spark.createDataFrame([(x,) for x in xs], "v string").select(secret_scan.ratio(F.col("v"), model).alias("r")).collect()]
    assert sum(s >= secret_scan.LEAST_RATIO for s in score(random_)) >= 0.97 * len(random_)
    assert sum(s >= secret_scan.LEAST_RATIO for s in score(ordinary)) <= 0.01 * len(ordinary)
    text = "the key " + random_[250] + " and " + ordinary[0]
    (r,) = secret_scan.scan(frame(spark, [(1, text)]), model).collect()
    assert r["spans"] == f"random:8:{8 + len(random_[250])}" and r["n_random"] == 1
