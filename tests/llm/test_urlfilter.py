import random
import re

import pyarrow as pa
import pytest

from paceline.llm import urlfilter as U


def regex(pattern: str) -> str:
    """The same pattern as a regular expression over characters, written from its definition."""
    out, host, k = "", True, 0
    while k < len(pattern):
        c = pattern[k]
        if c in "*?":
            out += ("[^/?]" if host else "[\\s\\S]") + ("*" if c == "*" else "")
        else:
            if c == "\\" and k + 1 < len(pattern):
                k += 1
            host = host and pattern[k] != "/"
            out += re.escape(pattern[k])
        k += 1
    return f"(?:{out}(?:[/?][\\s\\S]*)?)\\Z" if host else f"(?:{out})\\Z"


def brute(url, rules, globs, otherwise="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host, path, tail = re.match(r"([^/?#]*)([^?#]*)([^#]*)", rest).groups()
    host = host.translate(str.maketrans(U.UPPER, U.LOWER))
    fits = [r for r in rules if (host == r.host or host.endswith(f".{r.host}")) and (path.startswith(r.path))]
    if fits:
        best = min(fits, key=lambda r: (-len(r.label), -len(r.host), r.verdict != "block"))
        return host, path, best.label, best.verdict, None
    hit = [g for g in globs if re.match(regex(g.pattern), host + path + tail)]
    best = min(hit, key=lambda g: (-len(g.pattern), g.verdict != "block"), default=None)
    return host, path, None, best.verdict if best else otherwise, best.pattern if best else None


def judged(spark, urls, **kinds):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    return [tuple(r)[2:] for r in sorted(U.judge(df, **kinds).collect())]


URLS = [
    None, "", "no scheme", "http://", "http:///en/x", "HTTP://Example.COM/en/1", "https://www.example.com/en/", "https://www.example.com/EN/", "https://a.www.example.com/en/x?y#z", "http://example.com/en", "http://notexample.com/en/",
    "http://com/", "http://com", "http://com?/", "http://com#/", "http://x.net/es/", "http://x.net/es", "http://net/fr/a", "http://xnet/fr/", "http://x.org/x.com/", "http://x.org?u=.com/", "a://b://c.com/d", "http://casino.org", "http://casino.org/?q",
    "http://Big-CASINO.org:80/x", "http://a.casino-museum.org/", "http://x.org/casino", "http://x.org/a.exe", "http://x.org/a.exe?b", "http://x.org/a?b.exe", "http://x.org/ads/1", "http://x.org/b/ads/1", "http://x.org/ads", "http://ads.x.org", "http://ünï.org/é/login", "http://x.org/login", "http://x.com\n/en/",
    "http://x.org/" + "a" * 5000 + "/login", "http://" + "a." * 3000 + "net/fr/", "http://x.org/" + "/" * 700,
]


def test_contract_rules_against_brute_force(spark):
    assert judged(spark, URLS) == [brute(u, U.RULES, U.GLOBS) for u in URLS]


@pytest.mark.parametrize("words", [1, 64])
def test_random_patterns_against_regular_expressions(spark, words, monkeypatch):
    monkeypatch.setattr(U, "BLOCK_WORDS", words)
    rng = random.Random(words)

    def text(letters, most):
        return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))

    globs = [U.Glob(text("ab*?é.", 5) + rng.choice(["", "/" + text("ab*?é/\\", 6)]), rng.choice(["block", "allow"])) for _ in range(120)]
    urls = [f"http://{text('abAé.', 5)}{rng.choice(['', '/'])}{text('abé/?#*', 7)}" for _ in range(600)]
    rules = [U.Rule(text("ab.", 3), text("/ab*?", 3), rng.choice(["block", "allow"])) for _ in range(5)]
    rules = [r for r in rules if r.path.startswith("/") or not r.path]
    assert judged(spark, urls, rules=rules, globs=globs, otherwise="block") == [brute(u, rules, globs, "block") for u in urls]


def test_many_patterns_of_several_blocks():
    owned = [(f"*host{k}.org/{'p' * (k % 9)}*", k) for k in range(1500)]
    automata = U.blocks(owned)
    assert len(automata) > 3 and max(a.steps.shape[1] for a in automata) <= U.BLOCK_WORDS
    strings = [f"www.host{k}.org/pppppppppp" for k in range(0, 1500, 7)] + ["", "host1500.org/"]
    assert U.first_owner(automata, pa.array(strings), -1 % 2000).tolist() == [*range(0, 1500, 7), 1999, 1999]


def test_clashing_names_nulls_repeats_and_none(spark):
    df = spark.createDataFrame([(None, "http://net/es/", "a", 1), (None, "http://net/es/", "a", 1), (1, None, None, 2)], "page_id int, url string, verdict string, OWNER int")
    out = U.judge(df)
    assert out.columns == ["page_id", "url", "verdict", "OWNER", "host", "path", "rule", "pattern"]
    assert sorted((str(r.page_id), r.host, r.rule, r.verdict, r.OWNER) for r in out.collect()) == [("1", "", None, "allow", 2), ("None", "net", "net/es/", "block", 1), ("None", "net", "net/es/", "block", 1)]
    assert U.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in U.judge(df, rules=(), globs=()).collect()} == {"allow"}
