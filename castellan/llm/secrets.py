"""Credentials embedded in code, settings and command output.

Literals are taken from assignment contexts (names, flags, headers, URLs, SQL, prose) and
segmented into dictionary words by Viterbi.  What the words leave unexplained is the
residual: a long one in such a context is a credential; in a weak context it must be
longer.  Placeholders, look-ups, masked values and hashes known by label or place are
none.  The dictionary is counted over all distinct texts, outside of assigned values, so
that no credential explains itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castellan.operators.tables import cut

#: A word counts if it makes at least this share of all words counted (one a text), and so
#: many texts have it.  Not more than 1 / WORD_SHARE words can, so that is all the workers are
#: ever sent; nothing is cut.
WORD_SHARE, WORD_ROWS = 1e-5, 5
#: Unexplained characters that make a literal a credential.
LEAST_STRONG, LEAST_WEAK, LEAST_LENGTH = 3, 12, 6

# Words that name a credential, and formats of issued tokens.
_STRONG = r"(?:pass(?:word|wd|phrase|code)|passwd|pwd|(?<![a-z])pw|secret|token|api[_-]?key|access[_-]?key(?![_-]?id)|private[_-]?key|secret[_-]?key|signing[_-]?key|encryption[_-]?key|authorization|client[_-]?secret|auth[_-]?token|credentials?)"
_WEAK = r"(?:key|auth|pass|login|cred)"
_ISSUED = (
    r"(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{18,}|npm_[A-Za-z0-9]{30,}"
    r"|xox[abprs]-[A-Za-z0-9-]{20,}|AKIA[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
    r"|sk-ant-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{20,}"
)
_PLACEHOLDER = re.compile(
    r"(?i)^<[^>]*>$|\$\{|\{\{|^\$|^%\w+%$|^%\(|^@@|redacted|change.?me|placeholder|(?<![A-Za-z])your[-_ ]|^todo$|^none$|^null$|^true$|^false$|^undefined$"
    r"|^os\.environ|process\.env|getenv|getpass|^vault[:_./]|^env[:.]|^secrets?\.|^\W*$|^(?:.{0,8}?)([x*•#._-])\1{3,}.{0,4}$"
)
#: Words that make a literal a placeholder at its start or end, beside a separator or as a
#: part of camel case.
_FILLER_WORDS = "example|dummy|sample|insert|hidden|masked|environ"
_FILLER = re.compile(
    "|".join(
        rf"(?:^|(?<=[^A-Za-z0-9]))(?:{words})(?!{more})|(?<!{more})(?:{words})(?=[^A-Za-z0-9]|$)"
        for words, more in ((_FILLER_WORDS, "[a-z]"), (_FILLER_WORDS.upper(), "[A-Z]"), ("|".join(w.capitalize() for w in _FILLER_WORDS.split("|")), "[a-z]"))
    )
    + rf"|(?<=[a-z])(?:{'|'.join(w.capitalize() for w in _FILLER_WORDS.split('|'))})(?=[A-Z])"
)
# Names of digests, lengths of their hexadecimal forms, words that announce one.
_LABELLED_HASH = re.compile(r"(?i)^\{?(?:s?sha-?(?:1|2|3|224|256|384|512)?|s?md5|crc32|blake2[bs]?|blake3|pbkdf2|bcrypt|scrypt|argon2(?:id|i|d)?)(?:[_-]sha-?\d+)?[:$}_=-]")
_HEX_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
_DIGEST_LEAD = re.compile(r"(?i)(?:sha-?\d{1,3}|md5|digest|checksum|fingerprint|etag|hash(?:ed)?)[\w.-]{0,40}[\"'\]]?[ \t]*(?::=|=>|[:=]|\bis\b)?[ \t]*(?:\([ \t]*)?[\"'`]?$")
_URL = re.compile(r"^[a-z][a-z0-9+.-]*://", re.I)

_QUOTED = r"""(?:"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*'|`[^`\r\n]*`)"""
_JOIN = r"(?=[\s+])\s*+(?:[+\\]\s*+)?"
#: A value is one or more adjacent string pieces, or a bare word.
_VALUE = rf"(?P<quoted>{_QUOTED}(?:{_JOIN}{_QUOTED})*)|(?P<open>[\"'`])(?P<cut>[^\"'`\r\n]+)$|(?P<bare>[^\s\"'`,;<>(){{}}\[\]|\\]+)"
_SCHEME = r"(?:(?:bearer|basic|token|digest)[ \t]+)?"
_NAME_END = r"(?:[_-]?(?:value|text|pem|b64|base64))?"


def _context(lead: str, weak: bool = False) -> re.Pattern:
    return re.compile(rf"{lead}(?:{_VALUE})", re.I | re.M)


#: (pattern, weak): the value groups give the literal.
CONTEXTS: list[tuple[re.Pattern, bool]] = [
    # name = value, "name": "value", name := value, name => value; an opening bracket may precede pieces
    (_context(rf"{_STRONG}{_NAME_END}[\"'`\]]?[ \t]*(?::=|=>|=(?!=)|:(?!//))[ \t]*(?:\([ \t]*(?=[\"'`]))?{_SCHEME}(?:(?<=[ \t:=])(?:[rbuf]{{1,2}}(?=[\"']))?)"), False),
    (_context(rf"(?<![a-z]){_WEAK}[\"'`\]]?[ \t]*(?::=|=>|=(?!=)|:(?!//))[ \t]*(?:\([ \t]*(?=[\"'`]))?{_SCHEME}"), True),
    # flags, netrc lines and SQL users
    (_context(rf"(?<![\w-])--?{_STRONG}[ \t]+(?!-)"), False),
    (_context(r"\blogin[ \t]+\S+[ \t]+password[ \t]+"), False),
    (_context(r"\b(?:identified[ \t]+by|password)[ \t]+(?=')"), False),
    (_context(rf"{_STRONG}>(?=[^<])"), False),
    # prose: the token for x: v, key is v
    (_context(rf"\b{_STRONG}[ \t]+for[ \t]+\S+?:[ \t]+"), False),
    (_context(rf"\b(?:{_STRONG}|key)[ \t]+is:?[ \t]+"), True),
    # calls and column lists
    (_context(rf"{_STRONG}\([ \t]*(?=[\"'])"), False),
    (_context(rf"{_STRONG}[ \t]*\|[ \t]*"), False),
    (_context(r"\bbearer[ \t]+(?=[A-Za-z0-9])"), False),
    (_context(r"\bbasic[ \t]+(?=[A-Za-z0-9+/]{8,}={0,2}(?:[^A-Za-z0-9+/=]|$))"), False),
]
#: What a text must have (in lower case) for each context: None is a strong name.
_CONTEXT_SIGNS: list[tuple] = [
    (None, (":", "=")), (("key", "auth", "pass", "login", "cred"), (":", "=")), (None, ("-",)), (("login",), ("password",)), (("identified", "password"), ("'",)), (None, (">",)),
    (None, (" for", "\tfor")), (("pass", "pw", "secret", "token", "key", "auth", "cred"), (" is", "\tis")), (None, ("(",)), (None, ("|",)), (("bearer",),), (("basic",),),
]
_USERINFO = re.compile(r"[a-z][a-z0-9+.-]*://[^\s:/@\"'`<>]*:(?P<bare>[^\s/\"'`<>]+?)@(?=[\w\[.-])", re.I)
#: Contexts within one command: (word of the command, where in it the value is).
_FLAGS = [
    (re.compile(r"\bcurl\b", re.I), re.compile(r"[ \t](?:-u|--user)[ \t=]*[\"']?[^\s:\"']+:(?P<bare>[^\s\"']+)", re.I)),
    (re.compile(r"\bmysql\w*\b", re.I), _context(r"[ \t]-p(?=\S)")),
]
_COMMAND = re.compile(r"[^\r\n|;]+")
_LINE = re.compile(r"[^\r\n]+")
#: What is printed into a command that reads a password.
_STDIN = "--password-stdin"
_ECHO = _context(r"\becho[ \t]+(?:-n[ \t]+)?")
_INSERT = re.compile(r"\binsert[ \t]+into[ \t]+\S+[ \t]*\((?P<columns>[^()]*)\)[ \t]*values[ \t]*\((?P<row>(?:'(?:[^']|'')*'|[^)'])*)\)", re.I)
_CELL = re.compile(r"\s*(?:'((?:[^']|'')*)'|([^,']*))\s*(?:,|$)")
_KEY_BEGIN = re.compile(r"-----BEGIN (?P<label>(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----", re.I)
_PEM_BEGIN = re.compile(r"-----BEGIN ", re.I)
#: What may follow the BEGIN of a key that has no END: headers, runs of base64 (behind quotes,
#: comment signs or line numbers), a short last line.
_KEY_DATA = re.compile(r"(?:[\s\"'`+>|,;#*\[→]|\d{1,7}[\t→:|]|//(?=[ \t])|\\+[nrt]?|-(?!-))*+(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\r\n\\\"]*+|(?P<data>[A-Za-z0-9+/]{16,}+={0,2}+(?![\w=:(]|[.-]\w)))")
_KEY_TAIL = re.compile(r"[ \t\"'`+,;]*+(?:\r?\n|\\+n)(?:[ \t\"'`>|→]|\d{1,7}[\t→:|]|//(?=[ \t]))*+(?=[a-z]*+[A-Z0-9+/=])[A-Za-z0-9+/]{1,15}+={0,2}+(?=[ \t\"'`,;)]*+(?:[\r\n\\]|\Z))")
_BARE_ISSUED = re.compile(rf"(?<![A-Za-z0-9_/+-])(?:{_ISSUED})(?![A-Za-z0-9_])")
_STRONG_NAME = re.compile(_STRONG, re.I)
#: Texts without any of these can't hold a case (lower case; plain searches are much quicker
#: than patterns).
_STRONG_SIGNS = ("pass", "pwd", "pw", "secret", "token", "key", "authorization", "credential")
_ISSUED_SIGNS = ("k_live_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "xox", "akia", "aiza", "eyj", "sk-")
_SIGNS = (*_STRONG_SIGNS, *_ISSUED_SIGNS, "auth", "login", "cred", "bearer", "basic", "identified", "://", "curl", "mysql")
#: Phrases of several words, which no dictionary leaves unexplained: by name and form.
_PHRASE = re.compile(r"(?i)(?P<name>pass(?:phrase|word|wd|code)|pwd|secret)[\"'\]]?[ \t]*(?::=|=>|=(?!=)|:)[ \t]*(?P<quote>[\"'])(?P<phrase>[A-Za-z]{3,}(?:[ ][A-Za-z0-9]{3,}){2,15})(?P=quote)")
#: Fixed value: words of sentences about passwords, which phrases don't have.
_SENTENCE = frozenset(
    "the and are was has have must should shall can cannot could will would may please enter type your you our their for with without from not none does did this that these those its new old current at least"
    " character characters invalid incorrect wrong required missing match expired empty again field value reset change changed update updated confirm login user name set sent show hide forgot need needs use using used".split()
)
_PIECE = re.compile(_QUOTED)
#: A quoted piece before this is a name and no part of the value before it.
_NAME_BEHIND = re.compile(r"[ \t]*:")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Case(NamedTuple):
    start: int
    spans: tuple[tuple[int, int], ...]
    kind: str


class Dictionary:
    """Words with their costs in bits, for Viterbi segmentation."""

    CHARACTER = 6.2

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.found = ahocorasick.Automaton()
        for w, n in counts.items():
            self.found.add_word(w, (len(w), min(14.0, -math.log2(n / total))))
        if counts:
            self.found.make_automaton()
        self.empty = not counts

    def residual(self, text: str) -> int:
        """Characters, without separators, that the cheapest segmentation of the whole text
        leaves to single characters.  All words in the text are found in one pass, so time
        is linear however long it is."""
        low, n = _lower(text), len(text)
        ending: dict[int, list[tuple[int, float]]] = {}
        for last, word in () if self.empty else self.found.iter(low):
            size, begin = word[0], last + 1 - word[0]
            # a word has one case: lower, upper or capital first
            own, plain = text[begin : last + 1], low[begin : last + 1]
            if own == plain or own[1:] == plain[1:] or own == plain.upper():
                ending.setdefault(last + 1, []).append(word)
        best, came = [0.0] * (n + 1), [1] * (n + 1)
        for j in range(1, n + 1):
            cost, step = best[j - 1] + self.CHARACTER, 1
            for size, bits in ending.get(j, ()):
                if best[j - size] + bits <= cost:
                    cost, step = best[j - size] + bits, size
            best[j], came[j] = cost, step
        left, at = 0, n
        while at:
            step = came[at]
            if step == 1 and text[at - 1] not in " _-./:,":
                left += 1
            at -= step
        return left


_CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _lower(text: str) -> str:
    """Lower case of the same length."""
    return text.lower() if text.isascii() else text.translate(_CAPITALS)


def _usable(value: str, words: Dictionary, weak: bool, bare: bool) -> bool:
    if len(value) < LEAST_LENGTH or _PLACEHOLDER.search(value) or _FILLER.search(value) or _LABELLED_HASH.match(value) or _URL.match(value) or value.startswith("data:"):
        return False
    if any(c.isspace() for c in value) or len(set(value)) < 4:
        return False
    left = words.residual(value)
    if value.startswith(("/", "~/", "./", "../")):  # a path, unless hardly any of it is words
        return left >= LEAST_WEAK and left > len(value) // 2
    mixed = any(not c.isalpha() for c in value) or any(c.isupper() for c in value[1:]) and any(c.islower() for c in value)
    # words with a capital, a sign and any digit are a password; plain names with a digit aren't
    password = bool(re.search("[A-Z]", value) and re.search("[a-z]", value) and re.search("[0-9]", value) and re.search("[^A-Za-z0-9]", value))
    least = LEAST_WEAK if weak else LEAST_STRONG - 2 * password
    return left >= least and mixed or left >= 10


def _announced_digest(text: str, at: int, value: str) -> bool:
    """Whether a hexadecimal value of a digest's length is given to the name of a digest."""
    return bool(_HEX_DIGEST.fullmatch(value)) and bool(_DIGEST_LEAD.search(text, max(text.rfind("\n", 0, at), at - 80, 0), at))


def _value(m: re.Match) -> tuple[str, list[tuple[int, int]], bool]:
    """The literal of a match, its spans without quotes and scheme word, and whether it is bare."""
    if m.groupdict().get("quoted"):
        base, spans = m.start("quoted"), []
        for p in _PIECE.finditer(m["quoted"]):
            spans.append((base + p.start() + 1, base + p.end() - 1))
        text = m.string
        while len(spans) > 1 and _NAME_BEHIND.match(text, spans[-1][1] + 1):
            spans.pop()
        head = re.match(r"(?i)(?:bearer|basic|token)[ \t]+", text[spans[0][0] : spans[0][1]])
        if head:
            spans[0] = (spans[0][0] + head.end(), spans[0][1])
        return "".join(text[a:b] for a, b in spans), spans, False
    if m.groupdict().get("cut"):
        return m["cut"], [m.span("cut")], False
    a, b = m.span("bare")
    text = m.string
    while b > a and text[b - 1] in ".:?":
        b -= 1
    return text[a:b], [(a, b)], True


def _key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of private keys.  One without its own END before the next BEGIN goes as far as
    its lines look like key data; a BEGIN line alone is none."""
    for m in _KEY_BEGIN.finditer(text):
        after = _PEM_BEGIN.search(text, m.end())
        border = after.start() if after else len(text)
        if (last := re.compile(f"-----END {m['label']}-----", re.I).search(text, m.end(), border)) is not None:
            yield m.start(), last.end()
            continue
        end = stop = m.end()
        while (d := _KEY_DATA.match(text, stop, border)) is not None:
            stop = d.end()
            end = stop if d["data"] else end
        if end > m.end():
            tail = _KEY_TAIL.match(text, end, border)
            yield m.start(), tail.end() if tail else end


def find(text: str, words: Dictionary) -> list[Case]:
    """Credentials of one text, by position; overlapping ones count once."""
    found: list[Case] = []
    low = _lower(text)
    if not any(x in low for x in _SIGNS):
        return found
    for span in _key_blocks(text) if "private key" in low else ():
        found.append(Case(span[0], (span,), "private_key"))

    def add(value: str, spans: list[tuple[int, int]], weak: bool, bare: bool, kind: str) -> None:
        if spans and not _announced_digest(text, spans[0][0], value) and _usable(value, words, weak, bare):
            found.append(Case(spans[0][0], tuple(spans), kind))

    for m in _USERINFO.finditer(text) if "://" in text else ():
        add(m["bare"], [m.span("bare")], False, True, "url_password")
    for c in _COMMAND.finditer(text) if "curl" in low or "mysql" in low else ():
        for word, place in _FLAGS:
            if (w := word.search(text, c.start(), c.end())) is not None:
                for m in place.finditer(text, w.end(), c.end()):
                    add(*_value(m)[:2], False, True, "flag")
    for line in _LINE.finditer(text) if _STDIN in low else ():
        end = low.rfind("|", line.start(), max(line.start(), low.rfind(_STDIN, line.start(), line.end())))
        for m in _ECHO.finditer(text, line.start(), max(line.start(), end)):
            value, spans, bare = _value(m)
            add(value, spans, False, bare, "printed")
    for m in _INSERT.finditer(text) if "insert" in low else ():
        names = [c.strip() for c in m["columns"].split(",")]
        for name, cell in zip(names, _CELL.finditer(m["row"])):
            if cell[1] and _STRONG_NAME.search(name):
                a = m.start("row") + cell.start(1)
                add(cell[1], [(a, a + len(cell[1]))], False, False, "column")
    for m in _PHRASE.finditer(text) if '"' in text or "'" in text else ():
        parts = m["phrase"].lower().split()
        if len(parts) >= (3 if "phrase" in m["name"].lower() else 4) and not _SENTENCE & set(parts) and len(set(parts)) > 2 and not _FILLER.search(m["phrase"]):
            found.append(Case(m.start("phrase"), (m.span("phrase"),), "phrase"))
    strong = any(x in low for x in _STRONG_SIGNS)
    for (pattern, weak), signs in zip(CONTEXTS, _CONTEXT_SIGNS):
        if signs[0] is None and not strong or not all(any(x in low for x in one) for one in signs if one):
            continue
        for m in pattern.finditer(text):
            value, spans, bare = _value(m)
            # in a query string the value ends at the next parameter
            if bare and "&" in value and re.search(r"[?&][\w-]*$", text[max(0, m.start() - 40) : m.start() + 1] + "") or bare and "&" in value and "?" in text[max(0, spans[0][0] - 200) : spans[0][0]].split()[-1:][0]:
                value = value.split("&")[0]
                spans = [(spans[0][0], spans[0][0] + len(value))]
            add(value, spans, weak, bare, "assigned")
    for m in _BARE_ISSUED.finditer(text) if any(x in low for x in _ISSUED_SIGNS) else ():
        add(m[0], [m.span()], False, True, "issued_token")
    found.sort(key=lambda c: (c.start, -c.spans[-1][1]))
    out: list[Case] = []
    for c in found:
        if not out or c.start >= out[-1].spans[-1][1]:
            out.append(c)
    return out


def masked(text: str, cases: list[Case]) -> str:
    """``text`` with the characters of the values, but for line ends, as asterisks."""
    parts, at = [], 0
    for c in cases:
        for a, b in c.spans:
            parts += [text[at:a], re.sub(r"[^\r\n]", "*", text[a:b])]
            at = b
    return "".join([*parts, text[at:]])


FIELDS = (("tool_results", "result_content", "result_id"), ("tool_results", "stdout_text", "result_id"), ("findings", "evidence", "finding_id"))


def texts(tables: dict[str, DataFrame]) -> DataFrame:
    """src_table, field_name, row_key, text of every non-empty field."""
    parts = [
        tables[t].where(F.length(c) > 0).select(F.lit(t).alias("src_table"), F.lit(c).alias("field_name"), F.col(k).cast("long").alias("row_key"), F.col(c).alias("text"))
        for t, c, k in FIELDS
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What is assigned to a name or stands before the @ of a URL teaches no words.  The name is
#: looked for behind each sign of assignment only.
_ASSIGNED = r":(?://[^\s/@]{1,200}+@)|[:=](?<=(?i:pass|pwd|pw|secret|token|key|auth|cred)[\w-]{0,16}[\"'\]]?[ \t]{0,2}[:=])[=>]*+[ \t]*+[\"']?[^\s\"',;]++"


def learn_words(all_texts: DataFrame) -> dict[str, int]:
    """Words of all texts with the number of distinct texts that have them.

    Copies of a text count once, and what is assigned to a name doesn't count, else the
    letters of a credential would become a word.  Only the words of a text travel, under
    its digest, and each task sends a text once; the driver gets the words of WORD_SHARE.
    """
    plain = F.regexp_replace("text", _ASSIGNED, " ")
    tokens = F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), 0), lambda w: F.lower(w)))
    own = all_texts.select(F.unhex(F.md5("text")).alias("digest"), F.filter(tokens, lambda w: F.length(w).between(4, 24)).alias("words"))
    # no filter on words here: pushed below the projection it would find them twice
    once = own.groupBy("digest").agg(F.first("words").alias("words"))
    counted = cut(once.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    every = counted.agg(F.sum("n").alias("n")).first().n or 0
    least = max(WORD_ROWS, math.ceil(every * WORD_SHARE))
    return {r.word: r.n for r in counted.where(F.col("n") >= least).toLocalIterator()}


def _dictionary(df: DataFrame) -> object:
    return df.sparkSession.sparkContext.broadcast(learn_words(df))


def cases(all_texts: DataFrame) -> DataFrame:
    """src_table, field_name, row_key, start_pos, end_pos, kind of every credential."""
    words = _dictionary(all_texts)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Dictionary(words.value)
        for p in parts:
            rows = [
                (t, f, k, c.start, c.spans[-1][1], c.kind)
                for t, f, k, x in p.itertuples(index=False)
                for c in find(x, d)
            ]
            yield pd.DataFrame(rows, columns=["src_table", "field_name", "row_key", "start_pos", "end_pos", "kind"])

    return all_texts.mapInPandas(scan, "src_table string, field_name string, row_key long, start_pos int, end_pos int, kind string")


def redacted(all_texts: DataFrame) -> DataFrame:
    """Every text with its credentials masked, and their number."""
    words = _dictionary(all_texts)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Dictionary(words.value)
        for p in parts:
            found = [find(x, d) for x in p["text"]]
            p["text"] = [masked(x, c) for x, c in zip(p["text"], found)]
            yield p.assign(n_credentials=[len(c) for c in found])

    return all_texts.mapInPandas(scan, "src_table string, field_name string, row_key long, text string, n_credentials int")


def differs_only_in_masks(before: Column, after: Column) -> Column:
    """Whether ``after`` is ``before`` with some characters as asterisks."""

    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(x) == len(y) and all(p == q or q == "*" for p, q in zip(x, y)) for x, y in zip(a, b)])

    return F.pandas_udf(each, "boolean")(before, after)
