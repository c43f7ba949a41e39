"""URL filters: pattern rules indexed by their rarest literal token.

Rules are host and path rules (allow or block, the longest wins) and, for urls
that none of those fits, the patterns of a rule file: host anchors, wildcards
and regular expressions that block, or allow what others block. From each
expression the literal tokens are derived that any url it fits must hold. Tokens
are counted over the whole table once; each rule is filed under its rarest
token, and a url runs only the rules filed under its own tokens.

Tokens are runs of ASCII letters and digits, lower-cased. Rules and counts are
as large as the rule list, never as the table. A rule without a token, as one of
digits alone, is a candidate of every url.

Cases: a null url, or one without ``://``, has an empty host and path; no host
rule fits it, and a null url fits no pattern: it is allowed. Rows repeated, or
with a null id, are judged like any other. An empty table gives an empty
result, and its rules are indexed as if all counts were 0. Ties in the count go
to the longer token, then to the alphabet. A url of any length is judged whole.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files
from re import _constants as kind
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.plans.scratch import bound_arrow_batches
from meshnet.plans.tables import read_table

ALLOW, BLOCK = "allow", "block"
#: The host and path rules of the query.
HOST_RULES = [
    ("org/", ALLOW),
    ("example.org/es/", BLOCK),
    ("example.org/en/1", BLOCK),
    ("com/fr/", ALLOW),
    ("com/de/", BLOCK),
]
#: The rules of the query for urls that no host and path rule fits.
RULE_FILE = files("meshnet.llm").joinpath("url_rules.txt")
_TOKEN = re.compile("[0-9a-z]+")
_FLAGS = re.I | re.A | re.S
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN_CHARS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _takes_token_char(items: list) -> bool:
    """Whether a class like ``[^/?#]`` takes any character of tokens."""
    negated, found = False, set()
    for op, arg in items:
        if op is kind.NEGATE:
            negated = True
        elif op is kind.LITERAL:
            found.add(chr(arg).lower())
        elif op is kind.RANGE:
            found |= {c.lower() for c in _TOKEN_CHARS if arg[0] <= ord(c) <= arg[1]}
        else:
            return True  # a category: \w, \d, \S and their opposites are not looked into
    taken = {c for c in _TOKEN_CHARS.lower() if c in found}
    return bool(set(_TOKEN_CHARS.lower()) - taken) if negated else bool(taken)


def _parts_tokens(op, arg) -> bool:
    """Whether a part of an expression stands between tokens: an end of the text, or characters of no token."""
    if op is kind.AT:
        return arg in (kind.AT_BEGINNING, kind.AT_BEGINNING_STRING, kind.AT_END, kind.AT_END_STRING)
    if op is kind.LITERAL:
        return chr(arg) not in _TOKEN_CHARS
    if op is kind.IN:
        return not _takes_token_char(arg)
    if op is kind.BRANCH:
        return all(len(way) > 0 and all(_parts_tokens(*part) for part in way) for way in arg[1])
    if op is kind.SUBPATTERN:
        return len(arg[3]) > 0 and all(_parts_tokens(*part) for part in arg[3])
    if op in (kind.MAX_REPEAT, kind.MIN_REPEAT):
        return arg[0] > 0 and all(_parts_tokens(*part) for part in arg[2])
    return False


def _ends_apart(parts) -> bool:
    """Whether what comes after ``parts`` begins a token."""
    if not len(parts):
        return False
    op, arg = parts[-1]
    return _ends_apart(arg[3]) if op is kind.SUBPATTERN else _parts_tokens(op, arg)


def necessary_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that every text holds in which ``pattern`` is found.

    A run of literal letters and digits is one if the expression itself ends it
    on both sides; what alternatives, repetitions and look-arounds hold is not used.
    """
    found: dict[str, None] = {}
    run, whole = "", False

    def end(parted: bool) -> None:
        nonlocal run, whole
        if run and whole and parted:
            found[run] = None
        run, whole = "", parted

    def walk(parts) -> None:
        nonlocal run
        for op, arg in parts:
            if op is kind.LITERAL and chr(arg) in _TOKEN_CHARS:
                run += chr(arg).lower()
            elif op is kind.SUBPATTERN and not arg[1] and not arg[2]:
                walk(arg[3])
            elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT) and whole and not run and _ends_apart(arg[2]):
                pass  # there or not, the next token begins behind it
            else:
                end(_parts_tokens(op, arg))

    walk(_parser.parse(pattern, _FLAGS))
    end(False)
    return tuple(found)


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in the url, or for host rules in ``.host/path``; of those that fit the heaviest wins."""

    name: str
    verdict: str
    pattern: str
    weight: int = 0  # 0 for patterns of urls

    @property
    def tokens(self) -> tuple[str, ...]:
        return necessary_tokens(self.pattern)


def host_rule(rule: str, verdict: str) -> Rule:
    """A rule like ``example.org/es/``: the host and its subdomains, and paths that start so."""
    host, slash, rest = rule.partition("/")
    host = host.translate(_AZ)
    # Hosts are lower-cased and hold no slash; paths are compared as they are.
    return Rule(rule, verdict, rf"\A[^/]*\.{re.escape(host)}{re.escape(slash + rest)}", len(host + slash + rest))


def url_rule(line: str) -> Rule:
    """A line of a rule file; the signs are explained there. Its expression also runs in RE2."""
    name, verdict = line, BLOCK
    if line.startswith("@@"):
        line, verdict = line[2:], ALLOW
    if len(line) > 2 and line[0] == line[-1] == "/" and set(line) & set("\\[({"):
        return Rule(name, verdict, line[1:-1])
    pattern = ""
    if line.startswith("||"):
        line, pattern = line[2:], r"\A[^/?#]*://(?:[^/?#]*\.)?"
    elif line.startswith("|"):
        line, pattern = line[1:], r"\A"
    for i, c in enumerate(line):
        if c == "*":
            pattern += ".*"
        elif c == "^":
            pattern += "(?:^|[^0-9a-z])" if i == 0 else "(?:[^0-9a-z]|$)"
        else:
            pattern += re.escape(c)
    return Rule(name, verdict, pattern)


def read_rules(text: str) -> list[Rule]:
    """The rules of a rule file's text, without empty lines and comments."""
    lines = [line.strip() for line in text.splitlines()]
    return [url_rule(line) for line in lines if line and not line.startswith("!")]


def default_rules() -> list[Rule]:
    return [*(host_rule(r, v) for r, v in HOST_RULES), *read_rules(RULE_FILE.read_text("utf-8"))]


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(_AZ), m[2]


def tokens_of(url: str) -> set[str]:
    return set(_TOKEN.findall(url.translate(_AZ)))


class RuleIndex:
    """Rules by their rarest token; rules without any are candidates of every url."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            entry = (rule, re.compile(rule.pattern, re.S if rule.weight else _FLAGS))
            if tokens := rule.tokens:
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self.by_token[rarest].append(entry)
            else:
                self.always.append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        """Host, path, rule, verdict and the number of expressions run."""
        host, path = split_url(url)
        if url is None:
            return host, path, None, ALLOW, 0
        candidates = list(self.always)
        for token in tokens_of(url) & self.by_token.keys():
            candidates += self.by_token[token]
        place = f".{host}{path}"
        fit = [rule for rule, pattern in candidates if pattern.search(place if rule.weight else url)]
        best = max((r for r in fit if r.weight), key=lambda r: (r.weight, r.name), default=None)
        if best:
            return host, path, best.name, best.verdict, len(candidates)
        verdicts = {r.verdict for r in fit}
        return host, path, None, BLOCK if verdicts == {BLOCK} else ALLOW, len(candidates)


def count_tokens(df: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """How many urls hold each token of the rules; at most one row a token and task is sent."""
    bound_arrow_batches(df.sparkSession)
    wanted = {t for r in rules for t in r.tokens}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for t in tokens_of(url) & wanted:
                    total[t] += 1
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["token", "n"])

    urls = df.select(F.col(url_col).alias("url")).where("url is not null")
    found = urls.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in found.collect()}


def filter_urls(
    df: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_run``: one row per row of ``df``."""
    bound_arrow_batches(df.sparkSession)
    rules = default_rules() if rules is None else rules
    counts = count_tokens(df, rules, url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for batch in batches:
            judged = [index.judge(u) for u in batch.column(1).to_pylist()]
            columns = list(zip(*judged, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), pa.string()) for c in columns[:4]), pa.array(np.array(columns[4], np.int64))],
                ["page_id", "host", "path", "rule", "verdict", "n_run"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, n_run long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages``."""
    return filter_urls(read_table(spark, sf_dir, "pages")).drop("n_run")


_RULE_ROWS = ", ".join(
    f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}', {len(r)})" for r, v in HOST_RULES
)
_URL_ROWS = ", ".join(f"('(?is){r.pattern}', '{r.verdict}')" for r in default_rules() if not r.weight)
SQL = rf"""
WITH parts AS (
  SELECT page_id, url,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         row_number() OVER () AS n
  FROM pages
), rules AS (
  SELECT * FROM (VALUES {_RULE_ROWS}) AS r(rule, rule_host, rule_path, verdict, weight)
), fit AS (
  SELECT n, arg_max(rule, weight) AS rule, arg_max(verdict, weight) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n
), patterns AS (
  SELECT * FROM (VALUES {_URL_ROWS}) AS p(pattern, verdict)
), found AS (
  SELECT n, CASE WHEN bool_and(verdict = 'block') THEN 'block' ELSE 'allow' END AS verdict
  FROM parts JOIN patterns ON regexp_matches(url, pattern)
  GROUP BY n
)
SELECT page_id, host, path, fit.rule, coalesce(fit.verdict, found.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fit USING (n) LEFT JOIN found USING (n)
"""
