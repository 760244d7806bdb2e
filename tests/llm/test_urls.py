import math
import re
from collections import Counter, defaultdict

import pytest

from martlib.llm import urls as U

SF = "/root/testdata/sf0.01"


def split(url):
    url = url or ""
    if "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", tail)[0], tail


def ruled(host, path):
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def brute(pages, held, order=4):
    """Rules, models and cutoff by plain loops; ``held`` tells the URLs of the cutoff."""
    rows = []
    for page, url in pages:
        host, path, tail = split(url)
        rows.append((page, host, path, tail, *ruled(host, path)))
    grams = {v: Counter() for v in ("allow", "block")}
    for _, host, _, tail, _, said in rows:
        if said and not held[host, tail]:
            for text in (host, tail):
                padded = "\u0001" * order + text
                for i in range(len(text)):
                    for k in range(order + 1):
                        grams[said][padded[i + order - k : i + order + 1]] += 1
    totals, kinds = defaultdict(Counter), defaultdict(Counter)
    for said, counts in grams.items():
        for gram, n in counts.items():
            totals[said][gram[:-1]] += n
            kinds[said][gram[:-1]] += 1

    def logs(said, text):
        out, padded = 0.0, "\u0001" * order + text
        for i in range(len(text)):
            p = 1 / 256
            for k in range(order + 1):
                gram = padded[i + order - k : i + order + 1]
                n, t = totals[said][gram[:-1]], kinds[said][gram[:-1]]
                if n:
                    p = (grams[said][gram] + t * p) / (n + t)
            out += math.log(p)
        return out

    scored = []
    for page, host, path, tail, rule, said in rows:
        n = len(host) + len(tail)
        score = sum(logs("allow", x) - logs("block", x) for x in (host, tail)) / n if n else None
        scored.append((page, host, path, rule, said, score, bool(said) and held[host, tail]))
    bins = [(max(-U.BINS, min(U.BINS, math.floor(s / U.BIN))), said) for *_, said, s, h in scored if h and s is not None]
    best = None
    good, bad = (sum(said == v for _, said in bins) for v in ("allow", "block"))
    if good and bad:
        for b in sorted({b for b, _ in bins}):
            q = 1 - sum(x < b for x, s in bins if s == "allow") / good + sum(x < b for x, s in bins if s == "block") / bad
            if best is None or q > best[0] + 1e-12:
                best = (q, b)
    out = []
    for page, host, path, rule, said, score, _ in scored:
        model = "block" if best and score is not None and score < best[1] * U.BIN else "allow"
        out.append((page, host, path, rule, said or model, score))
    return sorted(out, key=str)


def held_of(urls):
    from pyspark.sql import functions as F

    held = F.pmod(F.xxhash64("host", "tail"), F.lit(U.HELD_OUT)) == 0
    return {(r.host, r.tail): r.h for r in urls.select("host", "tail", held.alias("h")).collect()}


def check(frame):
    got = sorted(map(tuple, U.judge_urls(frame).collect()), key=str)
    want = brute([(r.page_id, r.url) for r in frame.collect()], held_of(U.parts(frame)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == (None if w[5] is None else pytest.approx(w[5], abs=1e-9))


def test_query_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    check(pages.select("page_id", "url"))
    assert U.op1_url_filter(spark, SF).count() == pages.count()


def test_edges(spark):
    urls = [
        None, "", "no scheme", "http://", "http://ORG/x", "http://a.Org", "http://org", "http://xorg/", "http://É.org/", "x://y://z/p?q",
        "http://example.org/es/1", "http://a.example.org/es/", "http://example.org/ES/", "https://example.org/en/12", "http://b.com/fr/#x",
        "http://b.com/de/?q", "http://b.com?/fr/", "http://b.com#/de/", "http://c.net/" + "long/" * 3000, "http://a/b\nc?d",
    ]
    rows = [(i, u, "h", 1.0) for i, u in enumerate(urls)] + [(None, urls[4], "h", 1.0), (4, urls[4], "h", 1.0)]
    rows += [(100 + i, f"http://site{i}.org/a{i}", "h", 1.0) for i in range(30)] + [(200 + i, f"http://bad{i}.com/de/{i}", "h", 1.0) for i in range(30)]
    check(spark.createDataFrame(rows, "page_id long, url string, host string, score double"))


def test_without_both_kinds_everything_unruled_is_allowed(spark):
    frame = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.org/x")], "page_id long, url string")
    assert {r.verdict for r in U.judge_urls(frame).collect()} == {"allow"}
    assert U.judge_urls(frame.limit(0)).collect() == []
