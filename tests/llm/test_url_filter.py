import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshnet.llm import url_filter as op

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for rule, verdict in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return host, path, *best
    fit = {r.verdict for r in op.default_rules() if not r.weight and url is not None and re.search(r.pattern, url, re.I | re.A | re.S)}
    return host, path, None, "block" if fit == {"block"} else "allow"


URLS = [
    None, "", "no url", "http://", "http://example.org", "http://example.org/", "HTTP://WWW.Example.ORG/es/1", "http://notexample.org/es/",
    "http://example.org/en/12", "http://example.org/en/2", "http://a.b.com/fr/x?y://z", "http://com/fr/", "http://x.com/de/#f", "http://x.com?/de/",
    "http://x.com/DE/", "http://x.net/a-Casino_9", "http://x.net/casinos", "http://x.net/?q=PoRn", "a://b://x.org/", "http://x.com:80/fr/",
    "http://é.org/\n/es/", "http://example.org/es", "http://poker.org/", "://org/", "http://x.org/" + "a/" * 5000,
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in op.filter_urls(df).collect()}
    assert got == {(i, *brute(u)) for i, u in enumerate(URLS + URLS[:3])}
    assert op.filter_urls(df.limit(0)).count() == 0


_part = st.sampled_from(["http://", "://", "org", "example", "com", "www", ".", "/", "?", "#", "en", "es", "fr", "de", "1", "12", "casino", "-", "X", " ", "\n", "é"])


@settings(max_examples=400, deadline=None)
@given(st.lists(_part, max_size=12).map("".join), st.randoms())
def test_index_gives_what_all_rules_give(url, rng):
    rules = op.default_rules()
    counts = {t: rng.randint(0, 9) for r in rules for t in r.tokens}
    assert op.RuleIndex(rules, counts).judge(url)[:4] == brute(url)


def test_lines_of_a_rule_file():
    for line, fits, misses in [
        ("^casino^", ["http://x.net/a-Casino_9", "casino"], ["http://x.net/casinos"]),
        ("||ads.", ["http://ads.x.org/", "https://a.ads.b"], ["http://loads.org", "http://x.org/ads.html", "http://x.org/?u=http://ads.x"]),
        ("|http://*.tk^*^win^", ["http://a.tk/you-win"], ["https://a.tk/win", "http://a.tk/winner"]),
        ("/pixel*.gif?", ["http://x/pixel1.GIF?a"], ["http://x/pixel.gif"]),
        (r"/\.(zip|rar)([?#]|$)/", ["http://x/a.zip", "http://x/a.rar?b"], ["http://x/a.zip.html"]),
    ]:
        rule = op.url_rule(line)
        assert [bool(re.search(rule.pattern, u, op._FLAGS)) for u in fits + misses] == [True] * len(fits) + [False] * len(misses)
    assert op.url_rule("@@^sex^education^").verdict == "allow"
    names = [r.name for r in op.default_rules()]
    assert len(names) == len(set(names)) > 60
    assert {t for r in op.default_rules() for t in r.tokens} <= {t for n in names for t in op.tokens_of(n)}


@pytest.mark.parametrize(
    ("pattern", "tokens"),
    [
        ("abc", ()), ("^abc", ()), ("^abc$", ("abc",)), ("/abc/de", ("abc",)), ("[?&]sid=[0-9a-z]+", ("sid",)), ("(?:^|[^0-9a-z])bet(?:$|[^0-9a-z])", ("bet",)),
        ("/a(b|c)d/", ()), ("/abc?/x/", ("x",)), ("/abc[/]+x.y", ("abc",)), ("/abc/*x/", ()), (r"\babc\b", ()), (r"-ABC\W", ()), ("/(abc)/(d)(e)/", ("abc", "de")),
        ("/abc(?=/)x/", ()), ("/a.b/", ()), ("/a(?:|/)b/", ()), (r"\.(zip|rar)$", ()), ("_x[^a-z]y_", ()), ("_x[^a-z0-9]y_", ("x", "y")), ("/x(?i:Y)/", ()),
        (r"://(?:[^/?#]*\.)?ads\.", ("ads",)), ("/(a*)?ads/", ()), ("/a(b-)?c/", ()), ("/(b-)*c/", ("c",)),
    ],
)
def test_necessary_tokens(pattern, tokens):
    assert op.necessary_tokens(pattern) == tokens


_piece = st.sampled_from(
    ["a", "bc", "D9", "/", "-", r"\.", ".", ".*", "[a-c]", "[^a-z]", "[^0-9a-z]", "[/?]+", "/?", "x?", "(ab|/)", "(/|-)", "(?:^|[^0-9a-z])", "(?:[^0-9a-z]|$)", "(a)", "(?:/q/)", r"\w", r"\W", "[0-9]{2,}", "(?=/)", "(?!a)", "^", "$"]
)


@settings(max_examples=600, deadline=None)
@given(st.lists(_piece, min_size=1, max_size=7).map("".join), st.data())
def test_tokens_are_necessary(pattern, data):
    """Whatever text a pattern is found in holds its tokens."""
    try:
        expression = re.compile(pattern, op._FLAGS)
    except re.error:
        return
    text = data.draw(st.text("aAbBcdD9xq/-.? é\n", max_size=14) | st.text("ab/-", max_size=6))
    drawn = data.draw(st.from_regex(expression)) if not re.search(r"\(\?[=!]|[$^]", pattern) else ""
    for url in (text, drawn, text + drawn, drawn + text):
        if expression.search(url):
            assert set(op.necessary_tokens(pattern)) <= op.tokens_of(url)


def test_hundreds_of_rules_run_few_expressions():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    rules = [op.url_rule(rng.choice(["^{}^", "||{}.", "/{}/*.gif^", "/[?&]{}=[0-9]+/"]).format(w)) for w in words]
    urls = [f"https://www.{rng.choice(words)}.org/{rng.choice(words)}/{rng.choice(words)}.gif?{rng.choice(words)}=1" for _ in range(300)]
    counts = {}
    for t in (t for u in urls for t in op.tokens_of(u)):
        counts[t] = counts.get(t, 0) + 1
    index = op.RuleIndex(rules, counts)
    assert not index.always
    judged = [index.judge(u) for u in urls]
    assert [j[3] for j in judged] == ["block" if any(re.search(r.pattern, u, op._FLAGS) for r in rules) else "allow" for u in urls]
    assert {j[3] for j in judged} == {"allow", "block"} and sum(j[4] for j in judged) < 8 * len(urls)


def test_rarest_token_and_few_expressions():
    rules = op.default_rules()
    index = op.RuleIndex(rules, {"org": 1000, "example": 10, "es": 3, "en": 50, "com": 500, "fr": 70, "de": 70})
    assert {r.name for r, _ in index.by_token["es"]} == {"example.org/es/"}
    assert {r.name for r, _ in index.by_token["example"]} == {"example.org/en/1"}
    assert {r.name for r, _ in index.by_token["fr"]} == {"com/fr/"}
    assert index.judge("ftp://x.net/a/b/c")[4] == len(index.always) < 16


def test_counts_are_of_all_urls(spark):
    urls = [random.Random(i).choice(["http://a.org/es/", "http://a.com/fr/", None]) for i in range(300)]
    df = spark.createDataFrame([(u,) for u in urls], "url string").repartition(4)
    counts = op.count_tokens(df, [op.host_rule(*r) for r in RULES])
    assert counts == {"org": sum("org" in (u or "") for u in urls), "es": sum("es" in (u or "") for u in urls),
                      "com": sum("com" in (u or "") for u in urls), "fr": sum("fr" in (u or "") for u in urls)}
