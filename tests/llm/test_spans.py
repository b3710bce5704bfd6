import hashlib
import random
import re

from ledgersieve.llm import pii, secret_scan

from .conftest import ODD_TEXTS

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRETS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
              r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fits(kind, word):
    digits = re.sub("[^0-9]", "", word)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in word.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def plain_pii(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def plain_secrets(text):
    least = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20,
             "hex": lambda m: len(m[0]) >= 24}
    found = [(k, *m.span()) for k, p in SECRETS.items() for m in re.finditer(p, text or "") if least[k](m)]
    return sorted(found, key=lambda s: (s[1], list(SECRETS).index(s[0])))


def written(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def garbled(parts, n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_personal_data_matches_the_plain_patterns(docs_of, sample):
    parts = [*"01234567890123456789", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "%", "é", "😀",
             "4111111111111111", "192.168.1.1", "+1 (974) 555-3436", "x@y.z", "GB82 WEST 1234 5698 7654 32"]
    texts = garbled(parts, 600, 1) + [t for _, t in ODD_TEXTS] + [r.text for r in sample.collect()]
    texts += ["1" * 30_000, "a" * 50_000 + "@", "a@b" + ".c" * 20_000, "1.2.3.4 " * 700, "1 " * 30_000,
              "+1(((((" * 5000, "000000192.168.001.1 256.1.1.1 1.2.3.4.5.6.7.8"]
    got = {r.doc_id: r for r in pii.detect(docs_of(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = plain_pii(text)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert got[i].base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        assert got[i].spans.startswith(written(want))


def test_checks_and_context_add_spans(docs_of):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32."), (2, "GB83 WEST 1234 5698 7654 32"),
            (3, "call 555-123-4567 now"), (4, "part 555-123-4567"), (5, "ssn: 123-45-6789"),
            (6, "no 123-45-6789"), (7, "ssn: 666-45-6789")]
    spans = {r.doc_id: r.spans for r in pii.detect(docs_of(rows)).collect()}
    assert spans == {1: "iban:5:32", 2: "", 3: "local_phone:5:17", 4: "", 5: "ssn:5:16", 6: "", 7: ""}


def test_masked_texts(docs_of, no_docs, odd_docs):
    rows = [(1, "x a@b.co y 10.0.0.1"), (2, "+1 4111 1111 1111 1111 z"), (3, None), (4, "plain 😀")]
    masked = pii.mask(docs_of(rows))
    assert masked.columns == docs_of([]).columns
    # the phone pattern takes "+1 4111 1111 1111" on, but has too many digits
    assert {r[0]: (r[1], r[5]) for r in masked.collect()} == {
        1: ("x [EMAIL] y [IP]", 16), 2: ("+1 4111 1111 1111 1111 z", 24), 3: (None, None),
        4: ("plain 😀", 7)}
    again = pii.detect(masked).collect()
    assert all(r.spans == "" for r in again)
    assert pii.mask(no_docs).collect() == []
    assert pii.detect(no_docs).collect() == []
    assert pii.mask(odd_docs).count() == len(ODD_TEXTS)


def test_base_secrets_match_the_plain_patterns():
    parts = ["token", "PASSWORD", "api_key", "apiKey", "AKIA", "0123456789abcdef", "=", " ", ":", '"', "'",
             "\n", "abc", "Z9", "+", "ſecret", "x", "\\"]
    for text in garbled(parts, 4000, 2) + [t for _, t in ODD_TEXTS]:
        found = secret_scan.spans(text)
        assert [s for s in found if s[0] != "literal"] == plain_secrets(text)


def flagged(text):
    return [text[a:b] for a, b in secret_scan.literals(text)]


def test_literals_reach_sensitive_names():
    assert flagged('x = "aB3dE5gH7jK9mN1p"\nlogin.pwd = x\n') == ["aB3dE5gH7jK9mN1p"]
    assert flagged('a = "part1AB9"\nb = "pQ7rS8tU"\nauth_token = a + b') == ["part1AB9", "pQ7rS8tU"]
    assert flagged("private_key: Zx9Kq2Lm4Np8Rt6V") == ["Zx9Kq2Lm4Np8Rt6V"]
    assert flagged('{"credential": "9f8A7b6C5d4E3f2A"}') == ["9f8A7b6C5d4E3f2A"]
    assert flagged('a = "first"\na = "Zx9Kq2Lm4Np8Rt6V"\nsecret = a') == ["Zx9Kq2Lm4Np8Rt6V"]


def test_values_are_scored_whole():
    plain, odd = "-" * 5000, "kT9xQ2mVb7Lw4RzP"
    assert flagged(f'a = "{plain}"\nkey = a + "{odd}"') == [plain, odd]
    assert flagged(f'key = "{plain}{odd}"') == [plain + odd]
    long = odd * 300
    for tail in ("example", "exam"):
        rest = "ple" * (tail == "exam")
        assert flagged(f'password = "{long}" + "{tail}" + "{rest}"') == []
    assert flagged(f'password = "{long}{"changeme"}"') == []
    doubled = "\n".join(["a = a + a"] * 3000)
    assert flagged(f'a = "{odd}"\n{doubled}\npassword = a') == [odd]


def test_harmless_literals_stay():
    assert flagged('title = "aB3dE5gH7jK9mN1p"') == []
    assert flagged('secret = "changeme"\ntoken_count = 123456789') == []
    assert flagged("The token: a small thing. secret = yes") == []
    assert flagged('password = "a plain sentence"') == []


def test_endless_assignments_end():
    text = "a=a+a;" * 5000 + '"' * 20_001 + "token=" * 5000 + "'" * 9001 + "pwd = " + "x" * 50_000
    assert [s for s in secret_scan.spans(text) if s[0] != "literal"] == plain_secrets(text)


def test_scan_of_odd_rows(docs_of, no_docs):
    rows = ODD_TEXTS + [(50, 'token = "2b4c6d8e0f1a2b3c4d5e6f70"\nq = "Zx9Kq2Lm4Np8Rt6V"\nmy_pwd = q')]
    got = secret_scan.scan(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for i, t in rows if i == r.doc_id]
        assert r.base_sha256 in {hashlib.sha256(written(plain_secrets(t)).encode()).hexdigest() for t in texts}
    last = next(r for r in got if r.doc_id == 50)
    assert (last.n_assign, last.n_hex, last.n_literal) == (1, 1, 1)
    assert last.spans == "assign:0:33,hex:9:33,literal:40:56"
    assert secret_scan.scan(no_docs).collect() == []
