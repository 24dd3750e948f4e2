"""Secret scanning with a random forest against false positives, by DataFrame functions alone.

Candidates are long runs of key-like characters, private key blocks, values of
any length after an announcing word and ``=`` or ``:``, and what stands between
``user:`` and ``@host``. A value that is such a run is that run's finding; a
value that goes beyond a run is a finding of its own; runs inside a key block
are not reported again. A forest judges each candidate by its length, the
changes between kinds of characters, the share that dictionary words cover,
whether it is a path, and the words on both sides of it. The forest is trained
in numpy on labelled findings and then compiled to one SQL expression, so
scanning stays in DataFrame functions.

The labelled findings are made by rule (:func:`findings`): keys in the forms
that services issue, tokens, key blocks and passwords, beside the words that
announce them, and the look-alikes that scanners report wrongly. ``FINDINGS``
bounds their number. The dictionary is the ``WORDS`` most frequent whole words
of a public tokenizer's vocabulary, whose path is a parameter.

The result never shows a value: it has its place and its SHA-256.

Defined cases: a null text counts as empty. Repeated rows are scanned row by
row; an empty table gives an empty result; extra columns are never read.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import col, placed
from granary.llm.packing import tokenizer_path

#: What may be a secret: a run of key characters, at least 16.
KEY = "A-Za-z0-9+/_.~-"
CANDIDATE = rf"(?:\G|(?<![{KEY}]))[{KEY}]{{16,}}={{0,2}}"
QUOTES = r"\x22\x27\x60"
#: Words that announce a secret, and words that announce something harmless.
KEY_WORDS = "token|secret|password|passwd|pwd|api.?key|access.?key|private.?key|credential|auth|bearer"
PLAIN_WORDS = "commit|sha|sha1|sha256|md5|checksum|digest|revision|uuid|guid|example|sample|dummy|test|path|file|url|http|https|import|class|def|etag|build|version"
#: An announcing word, = or : and what opens a value; the value follows, in quotes or up to white space, a quote, a comma or a semicolon.
ANNOUNCED = (
    rf"(?i:(?=[tspacb])(?:{KEY_WORDS}))[A-Za-z0-9_-]{{0,16}}[{QUOTES}\])\x5C]{{0,4}}[ \t]{{0,4}}[=:][=:> \t]{{0,6}}\x5C?[{QUOTES}]?"
    rf"(?=((?<=\x22)[^\x22\n]{{1,256}}(?=\x22)|(?<=\x27)[^\x27\n]{{1,256}}(?=\x27)|(?![=:>])[^\s{QUOTES},;]*[^\s{QUOTES},;.)\]}}>\x5C]))"
)
#: The token of an Authorization header.
BEARER = rf"(?i:bearer|basic)[ \t]{{1,4}}(?=([{KEY}]{{8,15}}(?![{KEY}])))"
#: The password of ``user:password@host``.
LOGIN = rf"(?<=[A-Za-z0-9_.%+-]:)[^\s{QUOTES}@:/<>]++(?=@[A-Za-z0-9\[])"
#: A private key: its first line, and its lines as far as they follow.
BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s\x5C]*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)?+"
#: Code points on either side of a candidate whose words count.
NEAR = 40
FINDINGS = 6000
#: Words of the dictionary, the most frequent first, and letters that one has at least.
WORDS, LETTERS = 4000, 4
TREES, DEPTH, LEAF = 21, 7, 6
THRESHOLD = 0.5
#: How keys of some services begin.
ISSUED = "eyJ|AKIA|ASIA|gh[opsu]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|npm_|SG\\."


def dictionary(path: str | None = None, n: int = WORDS) -> list[str]:
    """Whole words of a tokenizer's vocabulary, in the order of their ids, which is that of their frequency."""
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    whole = re.compile("\u0120[a-z]{%d,}" % LETTERS)
    return [w[1:] for w in sorted((w for w in ids if whole.fullmatch(w)), key=ids.get)[:n]]


FEATURES = {
    "length": "length(v)",
    "changes": r"if(length(v) < 2, 0.0, (length(regexp_replace(k, r'(?s)(.)\1+', '$1')) - 1) / greatest(length(v) - 1.0, 1.0))",
    "digits": "(length(v) - length(regexp_replace(v, '[0-9]', ''))) / cast(length(v) as double)",
    "distinct": "size(array_distinct(split(v, ''))) / cast(length(v) as double)",
    "words": "aggregate(filter(regexp_extract_all(v, '[A-Z]?[a-z]+|[A-Z]+', 0), w -> length(w) >= {letters}), 0, (n, w) -> n + if(lower(w) in ({words}), length(w), 0)) / cast(length(v) as double)",
    "path": "cast(size(regexp_extract_all(v, '[/.]', 0)) as double)",
    "joins": "cast(size(regexp_extract_all(v, '[_-]', 0)) as double)",
    "vowels": "(length(v) - length(regexp_replace(lower(v), '[aeiou]', ''))) / cast(length(v) as double)",
    "hex": "if(v rlike '^[0-9a-f]+$', 1.0, 0.0)",
    "uuid": "if(v rlike '^[0-9A-Fa-f]{{8}}(?:-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}$', 1.0, 0.0)",
    "issued": f"if(v rlike r'^(?:{ISSUED})', 1.0, 0.0)",
    "block": "if(v like '-----BEGIN%', 1.0, 0.0)",
    "key_near": f"if(near rlike '(?:{KEY_WORDS})', 1.0, 0.0)",
    "plain_near": f"if(near rlike r'\\b(?:{PLAIN_WORDS})\\b', 1.0, 0.0)",
    "plain_after": f"if(after rlike r'^[^a-z0-9]{{{{0,8}}}}(?:{PLAIN_WORDS})\\b', 1.0, 0.0)",
    "placed": "if(near rlike '[=:][^A-Za-z0-9]*$', 1.0, 0.0)",
    "kinds": "if(v rlike '[a-z]', 1.0, 0.0) + if(v rlike '[A-Z]', 1.0, 0.0) + if(v rlike '[0-9]', 1.0, 0.0) + if(v rlike '[^A-Za-z0-9]', 1.0, 0.0)",
    "marks": "cast(size(regexp_extract_all(v, '[^A-Za-z0-9+/_.~-]', 0)) as double)",
    "hole": r"if(v rlike r'^[$<{{%*(\[]|[(\[{{]|^(?:x+|X+|[*.]+|[_-]+)$', 1.0, 0.0)",
    "spaced": "cast(size(regexp_extract_all(v, ' ', 0)) as double)",
    "login": r"if(near rlike r'(?:^|[^a-z])(?:[a-z0-9+.-]+://)?[a-z0-9_.%+-]+:$', 1.0, 0.0)",
    "mail": r"if(near rlike r'(?:mailto|mail|contact|sip|acct|xmpp|from|to|cc|by)[^a-z0-9]*:[^a-z0-9]*$', 1.0, 0.0)",
}
#: Kinds of characters: lower, upper, digit, other.
KINDS = "translate(translate(translate(v, 'bcdefghijklmnopqrstuvwxyz', repeat('a', 25)), 'BCDEFGHIJKLMNOPQRSTUVWXYZ', repeat('A', 25)), '123456789', repeat('0', 9))"


def featured(candidates: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Adds ``f``, a struct of the features, to rows with ``v`` (the candidate), ``near`` and ``after`` (lower-case text beside it)."""
    known = ", ".join(f"'{w}'" for w in words or dictionary())
    parts = ", ".join(f"cast({sql.replace('{words}', known).replace('{letters}', str(LETTERS)).replace('{{', '{').replace('}}', '}')} as double) as {name}" for name, sql in FEATURES.items())
    return candidates.selectExpr("*", f"{KINDS} as k").selectExpr("*", f"struct({parts}) as f")


def findings(n: int = FINDINGS, seed: int = 3, words: list[str] | None = None) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (form, before, value, after, label), every form equally often."""
    g = random.Random(seed)
    known = words or dictionary()
    word = lambda: g.choice(known)
    lead = lambda: " ".join(word() for _ in range(g.randint(1, 4))) + " "
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    of = lambda letters, k: "".join(g.choice(letters) for _ in range(k))
    alnum, hexa = lower + upper + digits, "0123456789abcdef"
    syllables = lambda k: "".join(g.choice("bcdfghklmnprstvwz") + g.choice("aeiou") + g.choice(["", "", "n", "r", "s", "l"]) for _ in range(k))
    asks = ["password = ", "pwd: ", "passwd=", 'password: "', "secret: ", "auth = ", "DB_PASSWORD=", "db_password: '", "password=", "Password: "]
    names = ["token = ", 'token = "', "api_key: ", "api_key=", 'apikey = "', "secret=", '"client_secret":"', "access_token: ", "auth_token=", "credential: ", "private_key = ", "Authorization: Bearer "]
    users = ["postgres://admin:", "user:", "ftp://anna:", "https://bot7:", "login root:", "mysql://app:", "redis://default:", "amqp://svc_x:"]
    mark = lambda: g.choice("&!$#%^*?@-_+")
    capital = lambda s: s[:1].upper() + s[1:] if g.random() < 0.5 else s
    mixed = lambda: of(alnum, g.randint(3, 9)) + mark() + of(alnum, g.randint(1, 6)) + of(digits, g.randint(1, 2))
    spelt = lambda: capital(word()) + of(digits, g.randint(1, 3)) + (word() if g.random() < 0.4 else "") + (mark() if g.random() < 0.3 else "")
    broken = lambda: of(lower, g.randint(1, 2)) + of(digits, 1) + of(hexa + upper, g.randint(3, 8)) + (word()[:4] if g.random() < 0.5 else "")
    in_url = lambda: "".join(c for c in g.choice([mixed, spelt, broken])() if c not in "@#?")
    issued = [lambda: "ghp_" + of(alnum, 36), lambda: "xoxb-" + of(digits, 11) + "-" + of(alnum, 24), lambda: "sk_live_" + of(alnum, 24), lambda: "AIza" + of(alnum + "_-", 35), lambda: "glpat-" + of(alnum + "_-", 20), lambda: "npm_" + of(alnum, 36), lambda: "SG." + of(alnum + "_-", 22) + "." + of(alnum + "_-", 43), lambda: "github_pat_" + of(alnum, 22) + "_" + of(alnum, 59)]
    jwt = lambda: ".".join(["eyJ" + of(alnum + "_-", g.randint(17, 50)), "eyJ" + of(alnum + "_-", g.randint(30, 160)), of(alnum + "_-", 43)])
    kind = ["", "RSA ", "EC ", "OPENSSH "]

    def block() -> str:
        k = g.choice(kind)
        body = "\n".join(of(alnum + "+/", 64) for _ in range(g.randint(1, 8)))
        return f"-----BEGIN {k}PRIVATE KEY-----" + (f"\n{body}\n-----END {k}PRIVATE KEY-----" if g.random() < 0.7 else "")

    code = lambda: g.choice([f"os.environ['{word()}']", "${" + word().upper() + "_" + word().upper() + "}", f"<{word()}-{word()}>", f"get_{word()}()", f"%({word()})s", "{{" + word() + "}}", f"config.{word()}", f"self.{word()}", "$" + word()])
    harmless = ["commit ", "sha ", "checksum: ", "sha256: ", "digest ", "revision ", "etag: ", "md5 ", "build "]
    forms = {
        "hex token": (lambda: (g.choice(names), of(hexa, g.choice([20, 24, 32, 40, 48, 64])), ""), 1),
        "base64 key": (lambda: (g.choice(names), of(alnum + "+/", g.randint(20, 64)) + g.choice(["", "=", "=="]), ""), 1),
        "access key": (lambda: (g.choice(["access key ", "key ", "aws ", ""]), g.choice(["AKIA", "ASIA"]) + of(upper + digits, 16), ""), 1),
        "issued key": (lambda: (g.choice(["", *names]), g.choice(issued)(), ""), 1),
        "jwt": (lambda: (g.choice(["", "jwt ", "cookie: ", *names]), jwt(), ""), 1),
        "key block": (lambda: (g.choice(["", "key:\n", "id_rsa "]), block(), ""), 1),
        "mixed password": (lambda: (g.choice(asks), mixed(), ""), 1),
        "spelt password": (lambda: (g.choice(asks), spelt(), ""), 1),
        "broken password": (lambda: (g.choice(asks), broken(), ""), 1),
        "login": (lambda: (g.choice(users), in_url(), "@host"), 1),
        "key with marks": (lambda: (g.choice(names), of(alnum, 4) + g.choice("~._-") + of(alnum + "~._-", g.randint(12, 40)), ""), 1),
        "bare key": (lambda: ("", of(alnum, g.randint(24, 48)), ""), 1),
        "quoted password": (lambda: (g.choice(['password: "', "pwd = '", '"password": "']), mixed()[:6] + g.choice([", ", " ", "; "]) + mixed(), ""), 1),
        "compound word": (lambda: ("of the ", g.choice(["", "_"]).join(capital(word()) for _ in range(g.randint(3, 6))), ""), 0),
        "path": (lambda: (g.choice(["", "the path ", "see ", "in "]), g.choice(["/usr/", "/home/", "./", "www.", "src/"]) + g.choice(["/", "."]).join(word() for _ in range(g.randint(2, 6))) + g.choice(["", ".html", ".py", ".txt"]), ""), 0),
        "checksum": (lambda: (g.choice(harmless), of(hexa, g.choice([32, 40, 64])), ""), 0),
        "checksum before": (lambda: ("", of(hexa, g.choice([32, 40, 64])), g.choice([" commit", " sha256", " checksum", ": digest of"])), 0),
        "bare hex": (lambda: ("", of(hexa, g.choice([32, 40])), ""), 0),
        "identifier": (lambda: (g.choice(["class ", "def ", "", "import "]), g.choice("_-").join(word() for _ in range(g.randint(3, 7))), ""), 0),
        "filled in": (lambda: (g.choice(names + asks), g.choice(["x", "X", "*", "."]) * g.randint(1, 24), ""), 0),
        "serial number": (lambda: (g.choice(["", "serial ", "id: ", "token = ", "no. "]), g.choice(["2024", "19", "00"]) + of(digits, g.randint(14, 20)), ""), 0),
        "plain word": (lambda: (g.choice(asks), g.choice([word, lambda: word().title(), lambda: g.choice(["none", "null", "true", "false", "required", "optional", "he", "a", "the", "N/A"])])(), ""), 0),
        "code": (lambda: (g.choice(asks + names), code(), ""), 0),
        "mail address": (lambda: (g.choice(["mailto:", "email:", "contact: ", "sip:"]), g.choice([f"{word()}.{word()}", f"{word()}{g.randint(1, 99)}", word()]), "@host"), 0),
        "count or phrase": (lambda: (g.choice(["tokens: ", "token count = ", 'secret: "', "auth: ", 'the password: "']), g.choice([str(g.randint(1, 9999)), " ".join(word() for _ in range(g.randint(2, 6)))]), ""), 0),
        "uuid": (lambda: (g.choice(["", "id: ", "uuid ", "guid="]), "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12)), ""), 0),
        "module": (lambda: (g.choice(["", "import ", "from "]), ".".join(word() for _ in range(g.randint(3, 6))) + g.choice(["", "-3.6.0", "-1.2.min.js"]), ""), 0),
        "ruler": (lambda: ("", g.choice("-_.~") * g.randint(16, 60), ""), 0),
        "hyphened": (lambda: ("", "-".join(word() for _ in range(g.randint(4, 7))), ""), 0),
        "long word": (lambda: ("", capital(syllables(g.randint(7, 12))), ""), 0),
    }
    rows = []
    for i in range(n):
        name = list(forms)[i % len(forms)]
        make, label = forms[name]
        before, v, after = make()
        rows.append((name, (lead() + before).lower(), v, (after or " " + lead()).lower(), label))
    return rows


def _table(spark: SparkSession, rows: list[tuple[str, str, str, str, int]]) -> DataFrame:
    """Findings as a table of one literal."""
    text = json.dumps([{"form": f, "near": b[-NEAR:], "v": v, "after": a[:NEAR], "label": y} for f, b, v, a, y in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<form:string,near:string,v:string,after:string,label:int>>")).alias("x")).select("x.*")


@dataclass
class Leaf:
    share: float


@dataclass
class Split:
    feature: int
    cut: float
    low: "Leaf | Split"
    high: "Leaf | Split"


def grow(x: np.ndarray, y: np.ndarray, g: np.random.Generator, depth: int) -> Leaf | Split:
    """A tree by Gini impurity over a random third of the features at each split."""
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return Leaf(float(y.mean()))
    best = (np.inf, 0, 0.0)
    for j in g.permutation(x.shape[1])[: -(-x.shape[1] // 3)]:
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = ones[:-1], ones[-1] - ones[:-1]
        impurity = 2 * left * (n - left) / n + 2 * right * (len(y) - n - right) / (len(y) - n)
        impurity = np.where((v[1:] > v[:-1]) & (n >= LEAF) & (len(y) - n >= LEAF), impurity, np.inf)
        i = int(np.argmin(impurity))
        if impurity[i] < best[0]:
            best = (float(impurity[i]), int(j), float((v[i] + v[i + 1]) / 2))
    if best[0] == np.inf:
        return Leaf(float(y.mean()))
    low = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], grow(x[low], y[low], g, depth - 1), grow(x[~low], y[~low], g, depth - 1))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Leaf | Split]:
    """A forest on bootstrap samples of labelled findings."""
    g = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        rows = g.integers(0, len(y), len(y))
        trees.append(grow(x[rows], y[rows], g, DEPTH))
    return trees


def forest_for(spark: SparkSession, n: int = FINDINGS, words: list[str] | None = None) -> list[Leaf | Split]:
    """The forest of ``n`` labelled findings, whose features the cluster's own expressions compute."""
    known = words or dictionary()
    rows = featured(_table(spark, findings(n, words=known)), known).select("f.*", "label").collect()
    data = np.array([[float(v) for v in r] for r in rows])
    return train(data[:, :-1], data[:, -1])


def as_sql(tree: Leaf | Split) -> str:
    if isinstance(tree, Leaf):
        return repr(round(tree.share, 6)) + "D"
    return f"if(f.{list(FEATURES)[tree.feature]} <= {tree.cut!r}D, {as_sql(tree.low)}, {as_sql(tree.high)})"


def vote(trees: list[Leaf | Split], row: np.ndarray) -> float:
    """The forest's mean share for one row of features."""
    total = 0.0
    for t in trees:
        while isinstance(t, Split):
            t = t.low if row[t.feature] <= t.cut else t.high
        total += round(t.share, 6)
    return total / len(trees)


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, s, e, v, near and after of every candidate."""
    given = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("t"))
    none = "cast(array() as array<string>)"
    found = given.selectExpr(
        "doc_id",
        "t",
        f"regexp_extract_all(t, r'{CANDIDATE}', 0) as runs",
        f"regexp_extract_all(t, r'{ANNOUNCED}', 0) as announced",
        f"regexp_extract_all(t, r'{BEARER}', 0) as bearers",
        f"if(contains(t, '@'), regexp_extract_all(t, r'{LOGIN}', 0), {none}) as logins",
        f"if(contains(t, 'PRIVATE KEY-----'), regexp_extract_all(t, r'{BLOCK}', 0), {none}) as blocks",
    ).filter("size(runs) + size(announced) + size(bearers) + size(logins) + size(blocks) > 0")
    kind = "struct<s:int,v:string,near:string,after:string>"

    def whole(name: str, pattern: str) -> str:
        at = f"transform({placed('t', f'{_raw(pattern)}', name, NEAR)}, x -> struct(x.s as s, x.v as v, x.before as near, x.after as after))"
        return f"if(size({name}) = 0, cast(array() as array<{kind}>), {at}) as {name}"

    def following(name: str, pattern: str) -> str:
        """Values that follow a match: the group that the pattern looks ahead to."""
        at = f"zip_with({placed('t', _raw(pattern), name, NEAR)}, regexp_extract_all(t, {_raw(pattern)}, 1), (x, v) -> struct(x.e as s, v as v, right(concat(x.before, x.v), {NEAR}) as near, substr(x.after, length(v) + 1) as after))"
        return f"if(size({name}) = 0, cast(array() as array<{kind}>), {at}) as {name}"

    found = found.selectExpr("doc_id", whole("runs", CANDIDATE), following("announced", ANNOUNCED), following("bearers", BEARER), whole("logins", LOGIN), whole("blocks", BLOCK))
    # A value of key characters alone is a run, or too short for one.
    values = f"filter(concat(announced, bearers, logins), x -> not x.v rlike '^[{KEY}]{{16,}}={{0,2}}$')"
    loose = "if(size(blocks) = 0, runs, filter(runs, x -> not exists(blocks, y -> y.s <= x.s and x.s < y.s + length(y.v))))"
    rows = found.selectExpr("doc_id", f"explode(concat({loose}, {values}, blocks)) as c")
    return rows.selectExpr("doc_id", "c.s as s", "c.s + length(c.v) as e", "c.v as v", "lower(c.near) as near", "lower(c.after) as after")


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = FINDINGS, words_path: str | None = None) -> DataFrame:
    """doc_id, start, end, value_sha256, probability and secret of every candidate."""
    known = dictionary(words_path)
    trees = forest_for(docs.sparkSession, n, known)
    judged = "(" + " + ".join(map(as_sql, trees)) + f") / {len(trees)} as probability"
    scored = featured(candidates(docs, doc_id, text), known).selectExpr("doc_id", "s as start", "e as end", "sha2(cast(v as binary), 256) as value_sha256", judged)
    return scored.withColumn("secret", F.col("probability") >= THRESHOLD)
