"""URL filters: all wildcard patterns at once, as a bit-parallel automaton.

A pattern is ``HOST/PATH`` with ``*`` (any run of characters), ``?`` (one character) and ``\\`` before a character that
stands for itself. Wildcards of the host part stop at its end; a pattern without ``/`` is about the host alone and fits
every path. Patterns are packed one after another into 64-bit words, a bit for each state. For every byte of all URLs of
a batch the states move on at once: shifted by one where the byte is what the next token takes (Shift-And), and kept
where a wildcard lets the byte pass. Long lists of patterns are cut into blocks of words, so that memory is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import read_table, unused, utf8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: URLs moved on together, and words of 64 states of one block of patterns.
ROWS = 4096
BLOCK_WORDS = 64


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, all its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def label(self) -> str:
        return f"{self.host}{self.path}"

    def globs(self) -> list[str]:
        def plain(text: str) -> str:
            return "".join(f"\\{c}" if c in "*?\\" else c for c in text)

        # an empty path fits whatever follows the host, which is what a pattern of the host alone does
        end = f"{plain(self.path)}*" if self.path else ""
        return [f"{plain(self.host)}{end}", f"*.{plain(self.host)}{end}"]


@dataclass(frozen=True)
class Glob:
    """``verdict`` for the canonical URLs that ``pattern`` fits as a whole."""

    pattern: str
    verdict: str


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

#: What decides where no rule fits; where none of these does either, a URL is allowed.
GLOBS = tuple(
    Glob(p, "block")
    for p in ("*casino*", "*poker*", "*viagra*", "*porn*", "*xxx*", "ads.*", "*.ads.*", "tracker.*", "*.doubleclick.*", "*/*.exe", "*/*.zip", "*/*.apk", "*/ads/*", "*/*/ads/*", "*/*/login*", "*/*wp-admin*", "*/*sessionid=*")
) + (Glob("*casino-museum*", "allow"),)

ANY = np.ones(256, bool)
#: A byte that starts a character, and a byte that continues one.
LEAD = ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))
IN_HOST = ANY.copy()
IN_HOST[list(b"/?")] = False


def states(pattern: str) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """For each state but the first the bytes that lead to it from the one before, for each state the bytes that keep it, and the final states."""
    steps, loops, host, k = [], [np.zeros(256, bool)], True, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            loops[-1] = loops[-1] | (IN_HOST if host else ANY)
        elif c == "?":
            steps.append(LEAD & IN_HOST if host else LEAD)
            loops.append(~LEAD)
        else:
            k += c == "\\" and k + 1 < len(pattern)
            host = host and pattern[k] != "/"
            for byte in pattern[k].encode():
                one = np.zeros(256, bool)
                one[byte] = True
                steps.append(one)
                loops.append(np.zeros(256, bool))
        k += 1
    final = [len(steps)]
    if host:  # then a path or a query may follow
        steps.append(~IN_HOST)
        loops.append(ANY)
        final.append(len(steps))
    return steps, loops, final


class Automaton:
    """One block of patterns. ``owner`` gives the number that stands for the pattern of a final state."""

    def __init__(self, patterns: Sequence[tuple[list, list, list, int]]):
        size = sum(len(loops) for _, loops, _, _ in patterns)
        bits = {name: np.zeros((256, 64 * -(-size // 64)), bool) for name in ("steps", "loops")}
        begin, final = np.zeros((2, bits["steps"].shape[1]), bool)
        self.owner = np.full(len(begin), -1, np.int64)
        at = 0
        for steps, loops, ends, owner in patterns:
            begin[at] = True
            for k, takes in enumerate(steps):
                bits["steps"][:, at + 1 + k] = takes
            for k, keeps in enumerate(loops):
                bits["loops"][:, at + k] = keeps
            for k in ends:
                final[at + k] = True
                self.owner[at + k] = owner
            at += len(loops)
        sink = final & bits["loops"].all(0)  # what is reached here stays reached
        self.steps, self.loops = (self.words(bits[name]) for name in ("steps", "loops"))
        self.begin, self.final, self.sink = (self.words(x[None])[0] for x in (begin, final, sink))

    @staticmethod
    def words(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def hits(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and owners of the patterns that fit whole strings; ``length`` must not rise."""
        now = np.repeat(self.begin[None], len(begin), 0)
        for j in range(int(length[0]) if len(length) else 0):
            n = np.searchsorted(-length, -j, "left")  # rows longer than j
            old, byte = now[:n], raw[begin[:n] + j]
            new = old << np.uint64(1)
            new[:, 1:] |= old[:, :-1] >> np.uint64(63)
            new &= self.steps[byte]
            new |= old & self.loops[byte]
            now[:n] = new
            if j % 256 == 255 and not (new & ~self.sink).any():
                break
        row, word = np.nonzero(now & self.final)
        reached = np.unpackbits((now & self.final)[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(reached)
        return row[k], self.owner[64 * word[k] + bit]


def blocks(owned: Sequence[tuple[str, int]]) -> list[Automaton]:
    """Automata of patterns and their owners, each of ``BLOCK_WORDS`` words or of one longer pattern."""
    out, block, size = [], [], 0
    for pattern, owner in owned:
        one = (*states(pattern), owner)
        if block and size + len(one[1]) > 64 * BLOCK_WORDS:
            out.append(Automaton(block))
            block, size = [], 0
        block.append(one)
        size += len(one[1])
    return [*out, Automaton(block)] if block else out


def first_owner(automata: Sequence[Automaton], strings: pa.Array, none: int) -> np.ndarray:
    """For each string the smallest owner of a pattern that fits it, or ``none``."""
    raw, offsets = utf8(strings)
    length = np.diff(offsets)
    out = np.full(len(length), none, np.int64)
    order = np.argsort(-length, kind="stable")
    for low in range(0, len(order), ROWS):
        rows = order[low : low + ROWS]
        for automaton in automata:
            row, owner = automaton.hits(raw, offsets[:-1][rows], length[rows])
            np.minimum.at(out, rows[row], owner)
    return out


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and the canonical URL: host, path and query. All are empty for null and without ``://``."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.concat(host, F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[Glob] = GLOBS, url_col: str = "url", names: Sequence[str] = ("host", "path", "rule", "verdict", "pattern"), otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, the rule that decides, the verdict, and the pattern that decides where no rule fits.

    Of several rules that fit the one with the longest text wins, then the one with the longer host, then a block; of
    patterns likewise the longest, then a block. Rules go before patterns; where nothing fits the verdict is
    ``otherwise``. A null URL and one without ``://`` have an empty host and path, which only a pattern such as ``*``
    fits. Rows are judged one by one, so repeated rows and null ids don't matter; very long URLs are read whole. The five new
    columns are called ``names``; a column of ``pages`` with such a name is replaced.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.label), -len(r.host), r.verdict != "block"))
    tried = sorted(globs, key=lambda g: (-len(g.pattern), g.verdict != "block"))
    automata = blocks([(g, k) for k, r in enumerate(ranked) for g in r.globs()] + [(g.pattern, len(ranked) + k) for k, g in enumerate(tried)])
    none = len(ranked) + len(tried)

    @F.arrow_udf("int")
    def decided(canonical: pa.Array) -> pa.Array:
        return pa.array(first_owner(automata, canonical, none), pa.int32())

    temporary = unused(pages.select(*pages.columns, *(F.lit(0).alias(n) for n in names)), "canonical", "owner", "own_host", "own_path")
    canonical, owner, own_host, own_path = temporary
    host, path, whole = parts(F.col(f"`{url_col}`"))
    found = pages.withColumns({own_host: host, own_path: path, canonical: whole}).withColumn(owner, decided(canonical))
    labels = F.array(*(F.lit(x) for x in [*(r.label for r in ranked), *(None for _ in tried), None])).cast("array<string>")
    verdicts = F.array(*(F.lit(x.verdict) for x in (*ranked, *tried)), F.lit(otherwise))
    patterns = F.array(*(F.lit(x) for x in [*(None for _ in ranked), *(g.pattern for g in tried), None])).cast("array<string>")
    at = F.col(owner)
    new = dict(zip(names, (F.col(own_host), F.col(own_path), F.get(labels, at), F.get(verdicts, at), F.get(patterns, at)), strict=True))
    return found.withColumns(new).drop(*temporary)


def op11_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern")


ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM u),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
g AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL WHEN host LIKE '%casino-museum%' THEN '*casino-museum*' WHEN host LIKE '%.doubleclick.%' THEN '*.doubleclick.*' WHEN tail LIKE '/%sessionid=%' THEN '*/*sessionid=*'
    WHEN tail LIKE '/%wp-admin%' THEN '*/*wp-admin*' WHEN host LIKE 'tracker.%' THEN 'tracker.*' WHEN tail LIKE '/%/ads/%' THEN '*/*/ads/*' WHEN tail LIKE '/%/login%' THEN '*/*/login*' WHEN host LIKE '%casino%' THEN '*casino*'
    WHEN host LIKE '%viagra%' THEN '*viagra*' WHEN host LIKE '%poker%' THEN '*poker*' WHEN host LIKE '%.ads.%' THEN '*.ads.*' WHEN tail LIKE '/%.exe' THEN '*/*.exe' WHEN tail LIKE '/%.zip' THEN '*/*.zip' WHEN tail LIKE '/%.apk' THEN '*/*.apk'
    WHEN starts_with(tail, '/ads/') THEN '*/ads/*' WHEN host LIKE '%porn%' THEN '*porn*' WHEN host LIKE '%xxx%' THEN '*xxx*' WHEN host LIKE 'ads.%' THEN 'ads.*' END AS pattern FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN pattern IS NULL OR pattern = '*casino-museum*' THEN 'allow' ELSE 'block' END AS verdict, pattern FROM g
"""
