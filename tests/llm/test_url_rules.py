"""URL rules in any number, against a plain loop."""

import random
import re

import pytest

from tributary.llm import urlfilter as u


@pytest.mark.parametrize("inline", [1000, 0])
def test_many_rules(spark, monkeypatch, inline):
    monkeypatch.setattr(u, "INLINE", inline)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    patterns = [u.PatternRule(f"p{i}", f"(^|[^a-z0-9]){a}[^a-z0-9](.*[^a-z0-9])?{b}([^a-z0-9]|$)", (a, b), rng.choice(["block", "allow"])) for i, (a, b) in enumerate(rng.sample(words, 2) for _ in range(60))]
    patterns.append(u.PatternRule("any", "x{3}", ()))
    hosts = [u.HostRule(rng.choice(["block", "allow"]), ".".join(rng.choices(words[:6], k=rng.randrange(1, 4))), rng.choice(["/", "/a/", "/a/b", ""])) for _ in range(50)]
    urls = [None, "", "://", "none", "http://", "http://W1.w2/xxx"] + [f"http{rng.choice(['', 's'])}://{'.'.join(rng.choices([w.upper() if rng.random() < .3 else w for w in words[:6]], k=3))}{rng.choice(['', '/a/', '/a/b/', '/A/'])}{'-'.join(rng.choices(words, k=6))}{rng.choice(['', '?q=w3-w4', '#w5', 'xxx'])}" for _ in range(300)]
    urls += urls[:20]
    got = {r.page_id: r for r in u.judge(spark.createDataFrame([(i, x, "h", 1) for i, x in enumerate(urls)], "page_id long, url string, rule string, hits int"), tuple(hosts), tuple(patterns)).collect()}
    assert len(got) == len(urls)
    for i, x in enumerate(urls):
        m = re.search("://([^/?#]*)([^?#]*)", x or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fits = [(-len(r.name), k, r) for k, r in enumerate(hosts) if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fits)[2] if fits else None
        hits = [r for r in patterns if re.search(r.pattern, (x or "").lower())]
        verdict = best.verdict if best else "block" if any(r.verdict == "block" for r in hits) else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best.name, verdict), x
        assert got[i].patterns == ",".join(r.name for r in hits)


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(empty).count() == 0 and u.judge(empty, (), ()).count() == 0
