"""URL filter, secret scan and decontamination."""

import base64
import json
import random
import re

from frames import AWKWARD, DOCS, clashing, docs
from pyspark.sql import functions as F

from pelagos.llm.decontamination import contained_items, remove_contaminated
from pelagos.llm.secrets import KINDS, find_secrets, scan_secrets
from pelagos.llm.url_filter import host_reputation, judge_urls


def tlv(tag, content):
    size = len(content)
    head = bytes([size]) if size < 128 else bytes([0x82]) + size.to_bytes(2, "big")
    return bytes([tag]) + head + content


KEY = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a\x86\x48") + b"\5\0") + tlv(4, bytes(range(200))))
JWT = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"me"}', b"signature"))
SSH = base64.b64encode(b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0" * 40).decode()


def base_spans(text):
    found = []
    for kind, pattern, holds in (
        ("assign", r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if holds(m)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def test_base_secrets_match_the_patterns(spark):
    rng = random.Random(6)
    bits = ["token", "PassWord", "api_key", "secret", "=", ": ", '"', "'", " ", "AKIA", "ABCD1234", "deadbeef", "é", "ſecret", "x", "\n", "abc", "0123456789abcdef", "😀"]
    texts = [*AWKWARD, *("".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(400))]
    got = scan_secrets(clashing(docs(spark, texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        own = [(s.start, s.end, s.kind) for s in r.secrets if s.kind in KINDS[:3]]
        assert own == base_spans(texts[r.id] or "")


def test_structures_are_confirmed():
    text = f"see {base64.b64encode(KEY).decode()} and {KEY.hex().upper()} and {JWT} and {SSH}."
    kinds = [k for _, _, k in find_secrets(text)]
    assert kinds.count("der") == 2 and kinds.count("jwt") == 1 and kinds.count("ssh") == 1
    armour = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(KEY).decode() + "-----END PRIVATE KEY-----"
    assert "pem" in [k for _, _, k in find_secrets(armour)]


def kinds_of(text):
    return [(k, s, e) for s, e, k in find_secrets(text) if k in KINDS[3:]]


def test_keys_at_any_offset_and_encoding():
    for before in ("", "3", "30", "3082", "ab30f", "00", "30" * 7):
        assert kinds_of(before + KEY.hex()) == [("der", len(before), len(before) + 2 * len(KEY))], before
    plain, safe = base64.b64encode(KEY).decode(), base64.urlsafe_b64encode(KEY).decode()
    assert kinds_of(safe) == [("der", 0, len(safe))] and kinds_of(plain.rstrip("=")) == [("der", 0, len(plain.rstrip("=")))]
    wrapped = "key:\n" + base64.encodebytes(KEY).decode() + "\nend"
    assert kinds_of(wrapped) == [("der", 5, wrapped.index("\n\nend"))]
    assert [k for k, _, _ in kinds_of("x" * 17 + "/" + plain)] == ["der"]


def test_encrypted_and_armoured_keys():
    algorithm = tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(0x30, tlv(4, b"salt") + tlv(2, b"\x08\0")))
    sealed = tlv(0x30, algorithm + tlv(4, bytes(range(160))))
    assert [k for k, _, _ in kinds_of(base64.b64encode(sealed).decode())] == ["der"]
    body = base64.encodebytes(KEY).decode()
    blocks = [
        "-----BEGIN PRIVATE KEY-----\n" + body + "-----END PRIVATE KEY-----",
        "-----BEGIN PRIVATE KEY-----\\n" + body.replace("\n", "\\n") + "-----END PRIVATE KEY-----",
        "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,0011\n\n" + base64.encodebytes(bytes(range(160))).decode() + "-----END RSA PRIVATE KEY-----",
        "-----BEGIN ENCRYPTED PRIVATE KEY-----\n" + base64.encodebytes(sealed).decode() + "-----END ENCRYPTED PRIVATE KEY-----",
    ]
    for block in blocks:
        assert ("pem", 3, 3 + len(block)) in kinds_of("xx " + block), block[:40]


def test_lengths_are_checked_at_every_level():
    deep = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a") + tlv(0x30, tlv(0x30, tlv(5, b"")))) + tlv(4, bytes(60)))
    assert [k for k, _, _ in kinds_of(deep.hex())] == ["der"]
    broken = deep.replace(bytes([0x30, 2, 5, 0]), bytes([0x30, 2, 5, 1]))
    assert broken != deep and not kinds_of(broken.hex()) and not kinds_of(base64.b64encode(broken).decode())


def test_secrets_of_awkward_tables(spark):
    assert scan_secrets(spark.createDataFrame([], DOCS)).count() == 0
    far = "word " * 100_000 + JWT
    got = scan_secrets(docs(spark, [JWT, JWT, far, None], [3, 3, None, None])).collect()
    assert sorted((r.id or -1, [(s.kind, s.start) for s in r.secrets]) for r in got) == [(-1, []), (-1, [("jwt", 500_000)]), (3, [("jwt", 0)]), (3, [("jwt", 0)])]


def test_what_only_looks_like_a_key_is_not_reported():
    broken = bytearray(KEY)
    broken[2] ^= 1
    header = base64.urlsafe_b64encode(json.dumps({"typ": "x"}).encode()).decode().rstrip("=")
    for text in (base64.b64encode(bytes(broken)).decode(), bytes(broken).hex(), f"{header}.{header}.x", base64.b64encode(b"openssh-key-v1\0" + b"\xff" * 60).decode(), "QUJD" * 30):
        assert not [k for _, _, k in find_secrets(text) if k in KINDS[3:]], text


def shingles(text, width):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_containment_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=k)) for k in (1, 3, 5, 8, 20, 40, 60, 60)] + [None, "", "Mixed CASE, words; here", "t1 t2", "t1 t2", "TIE"]
    items.append(items[4])
    texts = [*AWKWARD, "mixed case words here and there"]
    for _ in range(60):
        own = rng.choices(vocabulary, k=rng.choice([0, 5, 50, 3000]))
        passage = (items[rng.randrange(len(items))] or "x").split()
        cut = passage[: max(1, int(len(passage) * rng.uniform(0.6, 1)))]
        if rng.random() < 0.3:  # in two halves, far apart
            own = cut[: len(cut) // 2] + own + cut[len(cut) // 2 :]
        else:
            at = rng.randrange(len(own) + 1)
            own = own[:at] + cut + own[at:]
        texts.append(" ".join(own))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        for j, q in enumerate(items):
            own, item = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (t, q))
            a, b = shingles(t, 5), shingles(q, 5)
            if 0 < len(item) < 5:  # anywhere in the text
                if any(own[k : k + len(item)] == item for k in range(len(own))):
                    want[i, j] = (1, 1)
            elif len(own) >= 5 and b and len(a & b) >= 0.8 * len(b) - 1e-9:
                want[i, j] = (len(b), len(a & b))
    for block in (1 << 20, 40):
        got = contained_items(clashing(docs(spark, texts)), table, block_shingles=block).collect()
        assert {(r.id, r.item_id): (r.n_shingles, r.n_shared) for r in got} == want
        assert len(got) == len(want)
    kept = remove_contaminated(clashing(docs(spark, texts)), table)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {i for i, _ in want})


def test_containment_takes_ids_of_any_type(spark):
    text = "one two three four five six seven eight"
    for kind in ("int", "string", "decimal(9,2)", "binary", "date"):
        item = spark.createDataFrame([(text,), (None,)], "text string").selectExpr(
            f"CASE WHEN text IS NOT NULL THEN {'current_date()' if kind == 'date' else f'CAST(string(7) AS {kind})'} END AS item_id", "text"
        )
        got = contained_items(docs(spark, ["x y " + text * 1, "no", None]), item).collect()
        assert [(r.id, r.n_shared) for r in got] == [(0, 4)] and got[0].item_id is not None, kind


def test_containment_of_empty_tables(spark):
    empty, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert contained_items(empty, items).count() == 0
    df = docs(spark, ["a", None], [None, 1])
    assert remove_contaminated(df, items).count() == 2


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM", "https://a.example.com/en/1?q://x", "http://b.net/es/#t", "http://net/fr/", "x://u:p@h.co.uk:80?x", "://only", "http://notexample.com/en/", "http://www.example.com/en/", "http://sub.www.example.com/en/2", "http://" + "a" * 4000 + ".org/" + "p" * 9000, "http://É.example.com/en/"]
RULES = (["com/", "www.example.com/en/"], ["example.com/en/", "net/es/", "net/fr/"])


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule in RULES[0] + RULES[1]:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    rows = [(i, u, "html") for i, u in enumerate(URLS)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    outcomes = spark.createDataFrame([("http://bad.org/x", 0)] * 30 + [("http://good.org/x", 1)] * 30 + [("http://good.org/y", None)], "url string, good int")
    more = spark.createDataFrame([(100, "http://bad.org/1", ""), (101, "http://good.org/1", ""), (101, "http://good.org/1", "")], "page_id long, url string, html string")
    got = judge_urls(pages.select("page_id", "url", "html").union(more), outcomes, *RULES).collect()
    assert len(got) == len(URLS) + 3
    for r in got:
        if r.id < 100:
            assert (r.host, r.path, r.rule) == expected(URLS[r.id])
            if r.rule:
                assert r.verdict == ("allow" if r.rule in RULES[0] else "block")
        else:
            assert (r.verdict, r.n) == (("block", 30) if r.id == 100 else ("allow", 30))


def test_hosts_shrink_to_their_domain(spark):
    hosts = spark.createDataFrame(
        [("a.good.org", 50, 50), ("b.good.org", 40, 39), ("c.good.org", 0, 0), ("a.bad.org", 50, 2), ("b.bad.org", 60, 1), ("c.bad.org", 0, 0), ("d.bad.org", 1, 1)],
        "host string, n long, k long",
    )
    got = {r.host: r for r in host_reputation(hosts).collect()}
    assert got["c.good.org"]["mean"] > 0.7 > 0.4 > got["c.bad.org"]["mean"]
    assert got["d.bad.org"]["mean"] > got["c.bad.org"]["mean"]
    assert all(r.lower < r["mean"] for r in got.values())


def test_bad_hosts_are_blocked(spark):
    """Hosts with many bad outcomes are blocked, good ones of the same domain are not, and an unknown one follows them."""
    rng = random.Random(8)
    names = {f"h{i}.site{i % 5}.org": 0.15 if i % 4 == 0 else 0.9 for i in range(40)}
    outcomes = [(f"http://{h}/{j}", int(rng.random() < p)) for h, p in names.items() for j in range(60)]
    pages = [(i, f"http://{h}/x") for i, h in enumerate([*names, "new.site1.org"])] + [(None, None), (99, "http://h1.site1.org/y")]
    made = judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "url string, good int"), [], [])
    got = {r.host: r.verdict for r in made.collect()}
    assert {h for h in names if got[h] == "block"} == {h for h, p in names.items() if p < 0.5}
    assert made.count() == len(pages)
    clash = spark.createDataFrame([(u, g, "x", 1) for u, g in outcomes], "url string, good int, host string, n int")
    again = judge_urls(spark.createDataFrame(pages, "page_id long, url string"), clash, [], [])
    assert {r.host: r.verdict for r in again.collect()} == got


def test_no_outcomes_and_no_pages(spark):
    none = spark.createDataFrame([], "url string, good int")
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert judge_urls(pages, none, [], []).select("mean").first()["mean"] == 0.5
    assert judge_urls(pages.where(F.lit(False)), none, *RULES).count() == 0
