import datetime
import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tempora.llm import chat_format, license_scan, pii, url_filter

KEY = "k"


def test_license_scan_cases(spark):
    known = license_scan.builtin_licenses(spark)
    mit = next(t for i, t in license_scan.KNOWN if i == "MIT")
    docs = spark.createDataFrame(
        [
            (1, mit.upper().replace("<year> <copyright holders>", "1999 Somebody").replace("SUBLICENSE", "SUB-LICENSE").replace("\n", "\n  * "), "x"),
            (2, "Prose.\nreleased under the MIT licence!\n\nmore", "x"),
            (3, None, None), (4, "", None), (5, "... !!", None), (6, "Released under the MIT License, or not.", "x"),
            (None, "Licensed under CC BY 4.0", "x"), (7, "a " * 50_000, "x"), (2, "Prose.\nreleased under the MIT licence!\n\nmore", "x"),
        ],
        "doc_id long, text string, digest string",
    )
    hits = license_scan.scan_licenses(docs, known)
    got = sorted([tuple(r)[:4] for r in hits.collect()], key=str)
    assert got == sorted([(1, "text", -1, "MIT"), (2, "line", 1, "MIT"), (2, "line", 1, "MIT"), (None, "text", -1, "CC-BY-4.0"), (None, "line", 0, "CC-BY-4.0")], key=str)
    assert license_scan.scan_licenses(docs.limit(0), known).count() == 0


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10


TEXTS = [
    "card 4316522678525456 and 4316-5226-7852-5456, bad 4316522678525457.",
    "call +1 (743) 555-3824 or +44 743 555 3824; on 2024-02-29 and 29/02/2024 but not 2023-02-29 or 1850-01-01",
    "ssn 123-45-6789, not 000-12-3456; ip 10.20.30.40, not 300.1.1.1, version 1.2.3.4.5",
    'mail re.46@mail8.example.com&&& token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###',
    "", None, "plain words", "4316522678525456" * 1 + " x" * 30_000, "4316522678525456",
]


def test_pii(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, m string")
    out = {r.doc_id: r.text for r in pii.pseudonymise(df, KEY).collect()}
    assert out[4] == "" and out[5] is None and out[6] == "plain words"
    a, b, bad = re.fullmatch(r"card (\d{16}) and ([\d-]{19}), bad (\d{16})\.", out[0]).groups()
    assert a != "4316522678525456" and luhn(a) == 0 and b.replace("-", "") == a and bad == "4316522678525457"
    assert out[8] == a and out[7].startswith(a + " x") and len(out[7]) == len(TEXTS[7])
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+44 (\d{3}) (\d{3}) (\d{4}); on (\d{4}-\d\d-\d\d) and (\d\d/\d\d/\d{4}) but not 2023-02-29 or 1850-01-01", out[1]).groups()
    assert m[:3] == m[3:6] != ("743", "555", "3824")
    assert datetime.date.fromisoformat(m[6]) == datetime.datetime.strptime(m[7], "%d/%m/%Y").date() != datetime.date(2024, 2, 29)
    s, ip = re.fullmatch(r"ssn (\d{3}-\d\d-\d{4}), not 000-12-3456; ip ([\d.]+), not 300\.1\.1\.1, version 1\.2\.3\.4\.5", out[2]).groups()
    assert s != "123-45-6789" and all(int(o) < 256 for o in ip.split(".")) and ip != "10.20.30.40"
    assert re.fullmatch(r'mail u[0-9a-f]{16}@mail\.invalid&&& token = "[0-9a-f]{40}"###', out[3]) and "24be6443" not in out[3]
    back = {r.doc_id: r.b for r in pii.pseudonymise(df, KEY).select("doc_id", pii.pseudonymise_text(F.col("text"), KEY, back=True).alias("b")).collect()}
    assert all(back[i] == TEXTS[i] for i in (0, 1, 2, 6, 7))
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


def test_pii_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    beside = ["{} 123", "2 {}", "1227 {}", "{} 12/27", "{} 2027-01-01", "{} 123-45-6789", "{} 7@x.org", "7 {} 123 {} 99", "1 2 " * 2_000 + "{}"]
    texts = [b.replace("{}", c) for b in beside for c in (card, card.replace(" ", ""))] + ["24BE64439E3E49CF46B2D7C90F3602A3D0B907FF", "1234567890123 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in sorted(pii.pseudonymise(df, KEY).collect(), key=lambda r: r.doc_id)]
    for was, now in zip(texts[:-2], out, strict=False):
        assert len(now) == len(was) or "@" in was
        assert card not in now and card.replace(" ", "") not in now, was[-60:]
    assert all("2027-01-01" not in x and "123-45-6789" not in x and "7@x.org" not in x for x in out)
    assert re.fullmatch("[0-9A-F]{40}", out[-2]) and out[-2] != texts[-2] and out[-1] == texts[-1]


def _number(key, tweak, *parts):
    return int(hashlib.sha256("|".join([key, tweak, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def _permute(d, key, tweak):
    a = len(d) // 2
    left, right, p, q = int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + _number(key, tweak, i, right) % p) % p
        else:
            right = (right + _number(key, tweak, i, left) % q) % q
    return f"{left:0{a}d}{right:0{len(d) - a}d}"


def _feistel(left, right, p, q, key, tweak):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + _number(key, tweak, i, right) % p) % p
        else:
            right = (right + _number(key, tweak, i, left) % q) % q
    return left, right


def _sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def _refill(shape, number):
    rest = iter(number)
    return "".join(next(rest) if c in "0123456789" else c for c in shape)


def _plain_card(m):
    groups, gaps = re.findall("[0-9]+", m), re.split("[0-9]+", m)
    out, i = "", 0
    while i < len(groups):
        for j in range(min(i + 18, len(groups) - 1), i - 1, -1):
            run = "".join((gaps[k] if k > i else "") + groups[k] for k in range(i, j + 1))
            d = re.sub("[^0-9]", "", run)
            if 13 <= len(d) <= 19 and luhn(d) == 0:
                body = _permute(d[:-1], KEY + "#", "card")
                out += gaps[i] + _refill(run, body + next(c for c in "0123456789" if luhn(body + c) == 0))
                i = j + 1
                break
        else:
            out += gaps[i] + groups[i]
            i += 1
    return out


def _plain(m):
    """The pseudonym of one candidate in plain Python."""
    d = re.sub("[^0-9]", "", m)
    if "@" in m:
        return f"u{_sha(KEY, 'email', m.lower())[:16]}@mail.invalid"
    if m[0] == "+":
        return _refill(m, d[:-10] + _permute(d[-10:], KEY + "#", "phone"))
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}", m):
        shape = "%Y-%m-%d" if m[4] == "-" else "%d/%m/%Y"
        try:
            n = (datetime.datetime.strptime(m, shape).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            return m
        for _ in range(6):
            a, b = _feistel(n // 271, n % 271, 271, 271, KEY, "date")
            n = a * 271 + b
            if n < pii.DAYS:
                return (datetime.date(1900, 1, 1) + datetime.timedelta(n)).strftime(shape)
        return m
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return m
        a, b = _feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, KEY, "ssn")
        return f"{a + (2 if a > 664 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if re.fullmatch(r"\d+(\.\d+){3}", m):
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        a, b = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, KEY, "ipv4")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if re.fullmatch("[0-9A-Fa-f]{32,}", m):
        base = _sha(KEY, "secret", m)
        out = "".join(_sha(base, i) for i in range(len(m) // 64 + 1))[: len(m)]
        return out.upper() if re.search("[A-F]", m) and not re.search("[a-f]", m) else out
    return _plain_card(m)


def test_pii_of_whole_texts_equals_plain_python(spark, sf_dir):
    from tempora.llm.common import table

    rnd = __import__("random").Random(2)
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()] + TEXTS
    seeds = ["4316522678525456", "4316 5226 7852 5456", "12", "123-45-6789", "10.0.0.255", "2024-02-29", "31/12/1999", "a.b@c-d.example.org", "x@y", "+1 (743) 555-3824", "0F" * 20, "ab" * 16, "word", "2024", "-", "@", "..", "7" * 25]
    texts += ["".join(rnd.choice(seeds) + rnd.choice([" ", "-", ", ", "\n", ".", ""]) for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    texts += [" ".join(rnd.choice(["4316", "5226", "7852", "5456", "12", "900"]) for _ in range(3_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, KEY).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t if t is None else re.sub(pii.ANY, lambda m: _plain(m[0]), t)), t[:200]


def test_pii_long_runs_take_one_sweep(spark):
    texts = ["a@b" + ".c" * 20_000, "x" * 1_000_000, "x." * 300_000, "7" * 1_000_000, "0f" * 500_000, "a@" * 300_000, "a@b" + ".c" * 20_000 + ".org", "1 " * 100_000, "+" * 500_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, KEY).collect()}
    assert [got[i] == t for i, t in enumerate(texts)] == [True, True, True, False, False, True, False, True, True]


def test_feistel_is_a_permutation_and_equals_brute_force(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = {r.d: r.p for r in df.select("d", pii.permute_digits(F.col("d"), KEY, "t").alias("p")).collect()}
    assert len(set(got.values())) == 1000 and all(got[d] == _permute(d, KEY + "#", "t") for d in list(got)[:50])


def test_pii_query_leaves_no_private_value(spark, sf_dir):
    from tempora.llm.common import table

    was = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    now = {r.doc_id: r.text for r in pii.query(spark, sf_dir).collect()}
    assert was.keys() == now.keys()
    for i, t in was.items():
        for x in re.findall(r"[\w.]+@mail\d+\.example\.com|[0-9a-f]{40}|\+1 \(\d{3}\) 555-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b", t):
            decoy = (len(x) == 16 and x.isdigit() and luhn(x)) or (x.count(".") == 3 and x[0].isdigit() and "@" not in x and max(map(int, x.split("."))) > 255)
            assert (x in now[i]) == bool(decoy)
        if not re.search("[0-9@]", t):
            assert now[i] == t


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_url_filter_against_brute_force(spark):
    rules = [*url_filter.RULES, ("b.c", "/", "block"), ("a.b.c", "/x/y", "allow"), ("c", "/x", "allow"), ("co", "/", "block")]
    hosts = ["a.b.c", "b.c", "xb.c", "q.a.b.c", "c", "example.com", "WWW.Example.com", "www.example.com.", "net", "a.net", "com", "co", "", "a..com", "é.com", "b.c:80"]
    paths = ["", "/", "/x", "/x/y/z", "/en/", "/en", "/es/1?q=/en/", "/fr/#a", "?a", "#b"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "a://b://c/x", "http://com/" + "x" * 50_000, "http://a.b.c/x", "http://a.b.c/x"]
    df = spark.createDataFrame([(i, u, "k", "r") for i, u in enumerate(urls)], "page_id long, url string, key string, row string")
    rdf = spark.createDataFrame([*rules, (None, "/", "block"), ("b.c", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, rdf).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower() if m[1].isascii() else m[1], m[2]) if m else ("", "")
        assert (got[i].host, got[i].path) == (host, path) and (got[i].rule, got[i].verdict) == brute_rule(host, path, rules), u
        assert got[i].key == "k" and got[i].row == "r"
    assert url_filter.filter_urls(df.limit(0), rdf).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, rdf.limit(0)).collect()} == {"allow"}


def test_url_filter_with_deep_stacks_and_many_rules_of_a_host(spark):
    """Over many small ranges: a stack of 30 hosts and of 60 paths that stays open across them, and a host with 3,000 rules."""
    rnd = random.Random(6)
    nested = [".".join(["d"] * n) for n in range(1, 31)]
    rules = [(h, "/" + "a" * rnd.randint(0, 3), rnd.choice(["allow", "block"])) for h in nested] + [("q.d", "/" + "b" * n, f"v{n % 7}") for n in range(60)]
    rules += [("many.org", f"/{n:04d}", rnd.choice(["allow", "block"])) for n in range(3_000)] + [("a/b", "/", "block"), ("", "/z", "block"), ("many.org", "", "block")]
    urls = [f"s://{rnd.choice(nested)}/{'a' * rnd.randint(0, 5)}" for _ in range(150)] + [f"s://x.q.d/{'b' * rnd.randint(0, 70)}" for _ in range(100)]
    urls += [f"s://{rnd.choice(['', 'w.', 'v.w.'])}many.org/{rnd.randint(0, 3_500):04d}/x" for _ in range(150)] + ["s:///z", "s://many.org", "s://z./z", "s://\U0010ffff.d/\U0010ffff"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rdf = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rdf).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"^.*?://([^/?#]*)([^?#]*)", u)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (m[1] == h or m[1].endswith("." + h)) and m[2].startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow")), u


def test_chat_round_trip(spark):
    says = ["", None, "<|im_end|>", "<\\|x", "<\\\\|<|", "a\n<|im_sep|>b", "x" * 100_000, "<|im_start|>assistant ok", "é😀"]
    rows = [(1, i, r, t, 0) for i, (r, t) in enumerate((r, t) for t in says for r in ("user", "assistant", "assistant", "od%d\n<|r"))]
    rows += [(2, None, None, None, 0), (None, 1, "assistant", "n", 0), (3, 1, "user", "same", 0), (3, 1, "user", "same", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat_format.format_conversations(df).select("*", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    by = {r.conv_id: r for r in out}
    assert [(t.role, t.text) for t in by[1].t] == [(r, t or "") for _, _, r, t, _ in rows[: 4 * len(says)]]
    assert by[1].l == "".join(t or "" for t in says for _ in range(2)) and by[1].formatted.count("<|im_sep|>") == len(says)
    assert [tuple(t) for t in by[2].t] == [("", "")] and by[2].l == "" and by[None].l == "n" and len(by[3].t) == 2
    assert chat_format.format_conversations(df.limit(0)).count() == 0


FILES = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "BSD-3-Clause": "BSD", "CC0-1.0": "CC0-1.0", **{x: x for x in ("GFDL-1.2", "GFDL-1.3", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")}, "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the system has no licence texts")
def test_digests_are_those_of_public_texts(spark):
    """Every digest against the text that the system's packages carry."""
    there = {i: open(f"/usr/share/common-licenses/{f}", encoding="utf-8", errors="replace").read() for i, f in FILES.items() if os.path.isfile(f"/usr/share/common-licenses/{f}")}
    got = {(r.license_id, r.digest, r["size"]) for r in license_scan.known_digests(spark.createDataFrame(list(there.items()), "license_id string, text string")).collect()}
    assert got == {d for d in license_scan.DIGESTS if d[0] in there} and len(got) >= 10


def test_whole_texts_with_other_owners_and_line_breaks(spark):
    import textwrap

    bsd3 = next(t for i, t in license_scan.KNOWN if i == "BSD-3-Clause")
    bsd2, un, zlib = (next(t for i, t in license_scan.KNOWN if i == x) for x in ("BSD-2-Clause", "Unlicense", "Zlib"))
    wrapped = lambda t: "\n\n".join(textwrap.fill(p, 70) for p in t.split("\n\n"))
    rows = [(1, "Copyright (c) 2019, Jane Doe\nAll rights reserved.\n\n" + wrapped(bsd3)), (2, "BSD 2-Clause License\n\nCopyright 2020 A. Person\n\n" + wrapped(bsd2)), (3, wrapped(un).upper()), (4, wrapped(zlib)), (5, bsd3.replace("copyright holder nor", "owner nor"))]
    hits = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.builtin_licenses(spark), license_scan.builtin_digests(spark))
    assert {(r.doc_id, r.license_id) for r in hits.where("scope = 'text'").collect()} == {(1, "BSD-3-Clause"), (2, "BSD-2-Clause"), (3, "Unlicense"), (4, "Zlib")}


@pytest.mark.parametrize("name", ["op1_license_scans", "op4_line_dedup", "op5_pii", "op6_url_filters", "op9_chat_formatting"])
def test_no_python_in_plan(spark, sf_dir, name):
    from tempora.llm import registry

    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
