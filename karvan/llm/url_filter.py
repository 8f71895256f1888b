"""URL filters: explicit host and path rules first, a learned judge for the rest.

The judge is a logistic regression on hashed character n-grams of host and path, trained from a
small labelled URL table (a parameter of bounded size).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karvan.llm.linear import fit_logistic, sigmoid

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIMS = 1 << 16
GRAMS = (3, 4, 5)
#: (host and path, verdict); a rule fits its host and all subdomains.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: Words of unwanted and of ordinary sites. With the affixes and paths below, which both kinds
#: share, they are the labelled table; pass another one to ``train``.
UNWANTED = (
    "porn sex xxx adult escort hookup casino poker roulette slots jackpot betting bets gamble lottery viagra cialis pills pharmacy steroids "
    "payday loans replica spam malware phishing warez torrent crack keygen adserver adclick ads tracker tracking popunder clickbait spyware miracle-diet get-rich"
).split()
ORDINARY = (
    "news weather museum library university school garden recipes travel health science history theatre orchestra radio football gazette "
    "herald archive hospital council parliament bank insurance bakery florist bicycle railway airport harbour mountain river forest ocean island "
    "village market kitchen furniture pottery painting poetry novel physics chemistry biology geology astronomy software hardware wiki forum chess "
    "clothing something author thesis therapy weathering lighting reading writing building banking fishing sporting cable table double marble noble stable "
    "brother feather leather northern southern everything gathering thread thing path method rhythm north south monthly"
).split()
AFFIXES = ("{}", "{}s", "my{}", "{}hub", "{}365", "best-{}", "{}-shop", "free-{}", "cheap-{}", "{}-online", "the{}", "{}world", "{}-x", "e{}")
FRONTS, TOPS = ("", "www.", "m.", "blog."), ("com", "org", "net", "shop", "info", "example.com", "example.org", "example.net")
PLAIN_PATHS = ("", "/", "/en/1204", "/de/88231.html", "/fr/", "/es/401", "/articles/today", "/index.html")


def made_up_names(n: int = 400) -> list[str]:
    """Pronounceable names that mean nothing: no sign is no reason to block."""
    out, x = [], 1
    for _ in range(n):
        name = ""
        for _ in range(2 + x % 3):
            x = x * 1103515245 + 12345 & 0x7FFFFFFF
            name += "bcdfghklmnprstvwz"[x // 65536 % 17] + ("a", "e", "i", "o", "u", "ou", "er", "th", "un", "au")[x // 4096 % 10]
        out.append(name)
    return out


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 = block) of the default labelled table.

    A word stands in the host, in the path, or in both; affixes, tops and plain paths tell nothing.
    """
    out = [("", "", 0)] * 50 + [(f"{FRONTS[i % 4]}{name}.{TOPS[i % 8]}", PLAIN_PATHS[i % 7], 0) for i, name in enumerate(made_up_names())]
    plain = made_up_names(60)
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, word in enumerate(words):
            for j, affix in enumerate(AFFIXES):
                host, top = FRONTS[(i + j) % 4] + affix.format(word), TOPS[(i + 3 * j) % 8]
                out.append((f"{host}.{top}", PLAIN_PATHS[(i + j) % 8], label))
                if j % 3 == 0:
                    out.append((f"{plain[(i * 5 + j) % 60]}.{top}", f"/{word}/{10 * i + j}" if j % 2 else f"/en/{affix.format(word)}.html", label))
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased. Path: on up to ``? #``.

    A null url or one without ``://`` has an empty host and path.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        where, start = rule.split("/", 1)
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit("/" + start))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def url_features(host: str, path: str) -> np.ndarray:
    """Hashed character n-grams; host and path grams live in separate spaces."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = part.encode()
        for n in GRAMS:
            found.update(zlib.crc32(mark.encode() + raw[i : i + n]) % DIMS for i in range(len(raw) - n + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


def train(table: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    rows = [url_features(h, p) for h, p, _ in table]
    y = np.array([x for *_, x in table], np.float64)
    return fit_logistic(rows, y, DIMS, steps=400, l2=1e-4, scale=np.array([1 / np.sqrt(max(len(r), 1)) for r in rows]))


def judge_urls(pages: DataFrame, rules: tuple = RULES, table: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """Add ``host, path, rule, score, verdict`` to rows with ``url``.

    ``score`` is the learned probability of block; it decides where no rule fits. An url without
    a host is judged by the model's features of two empty strings. Columns of the same names
    in the input are replaced.
    """
    weights, bias = train(table or labelled_urls())
    model = pages.sparkSession.sparkContext.broadcast(weights)  # DIMS floats, whatever the data

    @F.pandas_udf("double")
    def block_score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = model.value
        for hosts, paths in parts:
            found = [url_features(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.Series([float(sigmoid(w[f].sum() / np.sqrt(max(len(f), 1)) + bias)) for f in found], dtype="float64")

    host, path = split_url(F.col("url"))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "score": block_score("host", "path")})
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
