"""Text kernels that need a state machine: sections, chunks, sentences, checked answers, tokens of identifiers."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TERMS, MAX_TERMS = 300, 800
HEADING = re.compile(r"(#{1,6})\s+(.*)")
END = re.compile(r"(?<=[.!?।])\s+")
#: Abbreviations that do not end a sentence.
SHORT = ("mr.", "mrs.", "ms.", "dr.", "no.", "rs.", "e.g.", "i.e.", "etc.", "vs.")
CITATION = re.compile(r"\[([A-Za-z0-9_.:#-]+)\]")
NUMBER = re.compile(r"(?<![\w#])\d[\d,]*(?:\.\d+)?%?(?!\w)")
YEAR = re.compile(r"(?:19|20)\d\d")


#: Where one term of the budget ends and another begins.
TERM_END = re.compile(r"[^\w%₹.]+|(?<=\d)(?=%)|(?<=[a-zA-Z])(?=\d)")


def terms(text: str) -> int:
    """Terms of a text for the budget of a chunk: words, with numbers and percent signs apart."""
    return sum(1 for t in TERM_END.split(text) if t)


def blocks(text: str) -> Iterator[tuple[tuple[str, ...], str, str]]:
    """(path of headings, kind, body): headings, paragraphs, tables and lists of a Markdown text, in order."""
    path: list[str] = []
    held: list[str] = []
    kind = ""

    def kind_of(line: str) -> str:
        s = line.lstrip()
        return "table" if s.startswith("|") else "list" if re.match(r"(?:[-*+]|\d+[.)])\s", s) else "paragraph"

    for line in [*text.split("\n"), ""]:
        heading = HEADING.match(line)
        now = "" if heading or not line.strip() else kind_of(line)
        if held and now != kind and not (kind == "list" and now == "paragraph" and line.startswith(" ")):
            yield tuple(path), kind, "\n".join(held)
            held = []
        if heading:
            path = [*path[: len(heading[1]) - 1], heading[2].strip()]
            yield tuple(path), "heading", line
        elif now:
            kind = kind if held else now
            held.append(line)


def sentences(text: str) -> list[str]:
    """Sentences; abbreviations do not end one, and a citation that follows belongs to the one before."""
    out: list[str] = []
    for part in END.split(text.strip()):
        if out and (out[-1].lower().endswith(SHORT) or CITATION.fullmatch(part.strip().rstrip("."))):
            out[-1] += " " + part
        elif out and (m := CITATION.match(part)):
            out[-1] += " " + m[0]
            if rest := part[m.end() :].strip():
                out.append(rest)
        elif part:
            out.append(part)
    return out


def chunks(key: str, text: str, least: int = MIN_TERMS, most: int = MAX_TERMS) -> list[tuple[str, str, str, int]]:
    """(id, path, body, terms): blocks packed up to ``most`` terms, under the path of their first one.

    A heading begins a chunk once the one before it has ``least`` terms; a
    shorter section goes on into the next. Headings stay in the body. A table is
    never split, even if it is larger than a chunk.
    """
    if least <= 0 or most < least:
        raise ValueError("the budget must be positive, and its floor below its ceiling")
    units: list[tuple[tuple[str, ...], str, str]] = []
    for path, kind, body in blocks(text):
        if kind in ("table", "heading") or terms(body) <= most:
            units.append((path, kind, body))
            continue
        part = ""
        for s in sentences(body):
            # A sentence beyond the budget is cut between its words.
            for piece in [s] if terms(s) <= most else s.split():
                if part and terms(part) + terms(piece) > most:
                    units.append((path, kind, part))
                    part = ""
                part = (part + " " + piece).strip()
        if part:
            units.append((path, kind, part))
    packed: list[list] = []
    for path, kind, body in units:
        n = terms(body)
        last = packed[-1] if packed else None
        if last is None or last[2] + n > most or (kind == "heading" and last[2] >= least):
            packed.append([path, body, n])
        else:
            last[1], last[2] = last[1] + "\n\n" + body, last[2] + n
    return [(f"{key}#{i:03d}-{hashlib.sha256(b.encode()).hexdigest()[:8]}", " > ".join(p), b, n) for i, (p, b, n) in enumerate(packed)]


def chunked(docs: DataFrame, key: str, text: str, least: int = MIN_TERMS, most: int = MAX_TERMS) -> DataFrame:
    """One row per chunk: key, chunk_id, path, body, terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *c) for k, t in zip(pdf["key"], pdf["text"], strict=True) for c in chunks(k, t or "", least, most)]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object if n != "terms" else "int64") for i, n in enumerate(("key", "chunk_id", "path", "body", "terms"))})

    given = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return given.mapInPandas(run, "key string, chunk_id string, path string, body string, terms bigint")


def checked(answer: str, resolvable: set[str]) -> tuple[str, int]:
    """The answer without sentences that claim a number and cite nothing that resolves, and how many went."""
    kept = []
    every = sentences(answer)
    for s in every:
        claims = [n for n in NUMBER.findall(CITATION.sub("", s)) if not YEAR.fullmatch(n)]
        if not claims or any(c in resolvable for c in CITATION.findall(s)):
            kept.append(s)
    return " ".join(kept), len(every) - len(kept)


def tokenised(column: Column, key: bytes, domain: str) -> Column:
    """HMAC-SHA256 of domain and trimmed value, 32 hexadecimal digits; null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else hmac.new(key, domain.encode() + b"\x00" + str(v).strip().encode(), hashlib.sha256).hexdigest()[:32] for v in values], dtype=object)

    return run(column.cast("string"))


def clipped_polygon(subject: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex one, half-plane by half-plane."""
    area2 = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))
    if area2(clip) < 0:
        clip = clip[::-1]
    for a, b in zip(clip, clip[1:] + clip[:1], strict=True):
        side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for x, y in subject]
        out = []
        for i, p in enumerate(subject):
            q, s, t = subject[i - 1], side[i], side[i - 1]
            if (s >= 0) != (t >= 0):
                f = t / (t - s)
                out.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s >= 0:
                out.append(p)
        subject = out
        if not subject:
            return []
    return subject


def overlap(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Intersection over union of two polygons, the second convex."""
    area = lambda p: abs(sum(u[0] * v[1] - v[0] * u[1] for u, v in zip(p, p[1:] + p[:1], strict=True))) / 2 if len(p) > 2 else 0.0
    shared = area(clipped_polygon(a, b))
    union = area(a) + area(b) - shared
    return shared / union if union else 0.0
