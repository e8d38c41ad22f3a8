r"""Credentials embedded in source code.

Each line is cut into lexical tokens. Those that can be a literal value (strong forms
anywhere; words, paths and placeholders where a secret's name stands before them) form a
chain that a linear-chain conditional random field labels O (other), B (a credential
begins) or I (it goes on, as in a literal split by ``+``). The features are a token's shape
(length, character mix, known forms) and its context (the names before it, quotes, URL
parts, comments), hashed to ``SPACE`` cells. Viterbi spans say exactly which characters are
redacted; all others stay.

There are no labelled rows, so the field is trained on a bounded sample of distinct lines
(``TRAIN_LINES``, picked by hash) of which only the sure cases carry a label: forms only
credentials have, strong literals given to a secret's name, passwords in URLs; placeholders,
digests, references. All other places of the chains have none: the likelihood sums over
their labels, and the field alone decides on them. Training runs in Spark tasks: each part
of the sample is fitted by itself, the weights are averaged, and so on for ``ROUNDS``. The
field then labels every distinct line of every finding; equal lines are labelled once and
joined back. What goes on in later lines
of a snippet (the body of a key block, a literal continued on the next line) is then carried
through its lines as I.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions.normalize import clean_id
from tidescan.session import materialise
from tidescan.sources.tables import table

#: Bound of the training sample, its parts and rounds, and the passes, batch and step size of a round.
TRAIN_LINES, PARTS, ROUNDS, EPOCHS, BATCH, RATE = 12_000, 8, 3, 3, 32, 0.05
#: Cells of the hashed features.
SPACE = 1 << 16
O, B, I = 0, 1, 2
#: I follows only B and I.
BANNED = -1e4
#: A place whose label the training does not know.
OPEN = -1

#: What each line with a non-empty chain has: in one run of atoms a digit, mixed case beside a special character, or letters that
#: are no words; a run of hex letters, the head of a known form, a key block's mark, a URL with a password, an authorization word, or
#: a secret's name.
ATOMS = r"[A-Za-z0-9_$#!%?+/.\-~^&*=]"
CANDIDATE = "|".join([
    rf"(?<!{ATOMS})(?={ATOMS}{{6}})(?:{ATOMS}*[0-9]|(?={ATOMS}*[a-z])(?={ATOMS}*[A-Z]){ATOMS}*(?:[#!%?^&*~]|(?<={ATOMS})\$))",
    r"(?:(?<![A-Za-z])|(?<=\)s))(?=[A-Z]*[a-z])(?![A-Z]?[a-z]*(?:[A-Z]+[a-z]{2,})*[A-Z]?(?![A-Za-z]))[A-Za-z]{14}",
    r"[0-9a-fA-F]{12}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-",
    r"AKIA|AIza|gh[pousr]_|github_pat_|glpat-|npm_|xox[abprs]-|sk_(?:live|test)_|rk_live_|sk-|SG\.|eyJ|hvs\.|shp(?:at|ss)_",
    r"PRIVATE KEY|-----END [A-Z0-9 ]*[0-9]|#\{[^}]*(?:[0-9]|[^\x00-\x7F])",
    r"(?s:://.*:.*@)|(?i:bearer|basic)(?![A-Za-z0-9_])",
    r"(?i:pass|pwd|secret|token|api[_\-]?key|cred|auth|(?:signing|private|access|encryption|account)[_\-]?key|jwt|login|dsn|psk|pw)|-u|--user",
])
NUMBERED = r"^(?:>>>)?\s*\d+ \| ?"

TOKEN = re.compile(
    r"-----(?:BEGIN|END) [A-Z0-9 ]+-----"
    r"|\$\{[^}\s]*\}|\$\([^)\s]*\)|\{\{[^}\n]*\}\}|%\([^)\s]*\)s|#\{[^}\s]*\}"
    r"|[A-Za-z][A-Za-z0-9+.\-]*://|\\[nrt]"
    r"|[A-Za-z0-9_$#!%?+/.\-~^&*]+(?:={1,2}(?=[\"'](?:[\s;,)\]}:]|$)|[\s;,)<]|$))?"
    r"|\S"
)

# Public forms of credentials.
KNOWN = re.compile(
    r"^(?:AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_\-]{30,}|gh[pousr]_[0-9A-Za-z]{20,}|github_pat_\w{20,}|glpat-[\w\-]{12,}|npm_[0-9A-Za-z]{20,}"
    r"|xox[abprs]-[0-9A-Za-z\-]{10,}|sk_(?:live|test)_[0-9A-Za-z]{12,}|rk_live_[0-9A-Za-z]{12,}|sk-[\w\-]{20,}|SG\.[\w\-]{10,}\.[\w\-]{10,}"
    r"|eyJ[\w\-]{8,}\.[\w\-]{8,}(?:\.[\w\-]+)?|[0-9a-f]{32}-us\d{1,2}|hvs\.[\w\-]{20,}|dop_v1_[0-9a-f]{30,}|shp(?:at|ss)_[0-9a-f]{20,}|ya29\.[\w\-]{20,})$"
)
KNOWN_START = re.compile(r"^(?:AKIA[0-9A-Z]{4}|AIza|gh[pousr]_|glpat-|npm_|xox[abprs]-|sk_live_|SG\.|eyJ)")
UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]{12,}$")
HASHED = re.compile(r"^(?:sha(?:1|256|384|512)-|md5-|sha(?:256|512):|\$2[aby]\$|\$argon2)")
# Words of placeholders.
PLACEHOLDER = re.compile(
    r"(?i)x{4,}|\*{4,}|\.{4,}|change[-_]?(?:me|it)|todo|replace[-_]?(?:me|this)?|your[-_]|example|placeholder|dummy|sample|redacted|set[-_]me|insert[-_]|^(?:null|none|nil|true|false|undefined|empty|test)$|^<|^\$[\{\(]|^\{\{|^%\("
)
REFERENCE = re.compile(r"(?i)^(?:vault|ssm|arn|secretref|secretsmanager|keyvault|kms|env|file|ref|op|consul|sops|projects|data|image|sha256|sha512|process\.env\S*|os\.environ\S*|os\.getenv|getenv|env\[?|secrets\.\S+)$")
SECRET_NAME = re.compile(
    r"(?i)(?:pass(?:w(?:or)?d|phrase)?s?|pwd|secrets?|tokens?|api[_\-]?key|api[_\-]?secret|apikey|credentials?|cred|authorization|auth|signing[_\-]?key|private[_\-]?key|access[_\-]?key|encryption[_\-]?key|account[_\-]?key|jwt|login|dsn)$|^-{1,2}(?:password|token|api-key|secret|user)$|^(?:pw|pass|psk)$|(?i:_pw|smtppass)$"
)
DIGEST_NAME = re.compile(
    r"(?i)(?:commit|checksum|sha\d*|digest|integrity|hash|etag|trace|uuid|guid|image|img|icon|fingerprint|revision|rev|nonce|version|label|md5|serial|build|ref|color|id)$"
)
SCHEME_WORD = re.compile(r"(?i)^(?:bearer|basic)$")
TYPE_WORD = re.compile(r"^(?:str|string|String|char|const|let|var|final|static|private|public|val|int|byte|object|any|auto)$")
COMMENT = re.compile(r"^\s*(?:#(?!define|include)|//|/\*|\*|--\s|;|<!--|%)")
# A private key block: its marks, and a line of it without indent, comment mark, quotes and line ends.
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
KEY_LINE = re.compile(r"^(?:\s|\\[nr]|[+\"'`]\s*(?=[\"'`A-Za-z0-9/]))*(?:(?:#|//|\*|--|;)\s+)?(?:[\"'`])?(?P<core>\S.*?)(?:(?:\\[nr])*[\"'`]\s*[+.,;)\\&]*|(?:\\[nr])+\\?|\\)?\s*$")
KEY_TEXT = re.compile(r"=?(?:[A-Za-z0-9+/]|\\[nr])+={0,2}")
KEY_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Comment|Version|Hash|Charset|MessageID): .*")
# A literal that ends its line and goes on in the next, and how the next line begins then.
GOES_ON = re.compile(r"^(?:[\"'`]\s*(?P<op>\+|\.\.?|&|\|\||<>)?\s*[\\_]?|(?P<open>\\))$")
GOING_ON = re.compile(r"\s*(?P<op>\+|\.\.?|&|\|\||<>)?\s*[fbruFBRU]{0,2}(?P<q>[\"'`])(?P<part>(?![&?#])[A-Za-z0-9_$#!%?+/.\-~^&*=]{2,})(?P=q)")
OPEN_PART = re.compile(r"\s*(?P<part>[A-Za-z0-9_$#!%?+/.\-~^&*=]+)")
ATOM = re.compile(r"[A-Za-z0-9_$#!%?+/.\-~^&*]")


def decoded(value: str) -> str | None:
    """The text of a base64 value, or None."""
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None


def family(v: str) -> str:
    """The form of a token, as one of a few names."""
    if v.startswith("-----BEGIN"):
        return "keyblock" if "PRIVATE KEY" in v else "block"
    if len(v) > 3 and v.endswith("://"):
        return "scheme"
    if not ATOM.match(v):
        return "mark"
    if len(v) < 6:
        return "number" if v.isdigit() else "placeholder" if PLACEHOLDER.search(v) else "word"
    if PLACEHOLDER.search(v):
        return "placeholder"
    if KNOWN.match(v):
        return "known"
    if UUID.match(v):
        return "uuid"
    if HASHED.match(v):
        return "hashed"
    if HEX.match(v):
        return "hex"
    if v.replace(".", "").replace(",", "").isdigit():
        return "number"
    upper, lower, digit = any(c.isupper() for c in v), any(c.islower() for c in v), any(c.isdigit() for c in v)
    special = any(c in "#!%?^&*~" or c == "$" and k for k, c in enumerate(v))
    if KNOWN_START.match(v) and len(v) >= 10:
        return "knownpart"
    if PARTS_OF_WORDS.match(v):
        return "path"
    if len(v) >= 20 and upper and lower and digit and re.fullmatch(r"[A-Za-z0-9+/=_\-]+", v):
        return "long"
    code = CODE.search(v)
    if special and len(v) >= 8 and upper and lower and digit and not re.search(r"&&|//|\.[a-z]", v):
        return "symbols"
    if len(v) >= 14 and upper and lower and re.fullmatch(r"[A-Za-z]+", v) and not re.fullmatch(r"[A-Z]?[a-z]*(?:[A-Z]+[a-z]{2,})*[A-Z]?", v):
        return "letters"
    if special and not code and (upper and lower or digit and (upper or lower)):
        return "symbols"
    if len(v) >= 8 and digit and (upper or lower) and re.fullmatch(r"[A-Za-z0-9+/=\-]+", v) and (upper and lower):
        return "mixed"
    if "/" in v or v.count(".") > 1:
        return "path"
    if len(v) >= 6 and digit and (upper or lower):
        return "digits"
    return "word"


#: Words and short codes between slashes.
PARTS_OF_WORDS = re.compile(r"^(?:[A-Z]{0,5}\d{0,3}(?:[A-Z]?[a-z]{2,})*/)+[A-Z]{0,5}\d{0,3}(?:[A-Z]?[a-z]{2,})*$")
#: Marks of an expression rather than of a value.
CODE = re.compile(r"//|&&|\*\*|\+\+|--|[?!.*&][a-z_.]|^[#*&]|\?$")
STRONG = {"known", "knownpart", "long", "symbols", "mixed", "hex", "digits", "uuid", "letters"}


#: What stands before a value.
VALUE_MARKS = {'"', "'", "`", ":", "=", ">", "(", ","}


def tokenise(line: str) -> tuple[list[str], list[int]]:
    toks, at = [], []
    for m in TOKEN.finditer(line):
        toks.append(m[0])
        at.append(m.start())
    return toks, at


def name_class(v: str) -> str:
    if v in ("-u", "--user"):
        return "secret"
    bare = v.strip("$:.-") if not v.startswith("--") else v
    last = re.split(r"[.]", bare)[-1] if "." in bare else bare
    if SECRET_NAME.search(last) or SECRET_NAME.search(bare):
        return "secret"
    if SCHEME_WORD.match(v):
        return "auth"
    if REFERENCE.match(v):
        return "reference"
    if PLACEHOLDER.search(v):
        return "placeholder"
    if DIGEST_NAME.search(last):
        return "digest"
    return "plain"


class Line:
    """The tokens of a line, the chain of those that can be a value, and their context."""

    def __init__(self, text: str):
        self.text = text
        self.toks, self.at = tokenise(text)
        self.fams = [family(t) for t in self.toks]
        self.comment = bool(COMMENT.match(text))
        self.chain: list[int] = []
        self.names: dict[int, list[str]] = {}
        n = len(self.toks)
        self.quoted, self.alone, self.part = [False] * n, [False] * n, [""] * n
        self._url_parts()
        quote, since = "", 0
        atoms: list[str] = []
        for k, (t, f) in enumerate(zip(self.toks, self.fams, strict=True)):
            if t in ('"', "'", "`"):
                if quote == t:
                    quote = ""
                elif not quote:
                    quote, since = t, k
            self.quoted[k] = bool(quote)
            self.alone[k] = bool(quote) and since == k - 1 and k + 1 < n and self.toks[k + 1] == quote
            if f == "mark":
                continue
            joined = self.alone[k] and k >= 4 and self.toks[k - 2] in ("+", ".") and bool(self.chain) and self.chain[-1] == k - 4
            after_auth = bool(atoms) and len(t) >= 8 and SCHEME_WORD.match(atoms[-1]) is not None
            names = ([name_class(x) for x in atoms[:-4:-1]] + ["none"] * 3)[:3] if f != "scheme" else []
            named = f in ("word", "path", "placeholder") and len(t) >= 4 and "secret" in names[:2] and self.before(k) in VALUE_MARKS
            if f == "digits" and not self.part[k] and "secret" not in names[:1] and self.after(k) in ("=", ":"):
                atoms.append(t)  # a name, whose value follows
                continue
            if f in STRONG or f == "keyblock" or (self.part[k] == "password" or after_auth or joined) and f not in ("placeholder", "scheme") or named:
                self.chain.append(k)
                self.names[k] = names
            if ATOM.match(t) and not TYPE_WORD.match(t):
                atoms.append(t)

    def _url_parts(self) -> None:
        n = len(self.toks)
        for k, f in enumerate(self.fams):
            if f != "scheme":
                continue
            # user ":" password "@" host, all without blanks
            j, colon = k + 1, -1
            while j < n and self.at[j] == self.at[j - 1] + len(self.toks[j - 1]) and self.toks[j] not in ('"', "'", "`", ",", ";", ")"):
                if self.toks[j] == ":" and colon < 0:
                    colon = j
                if self.toks[j] == "@":
                    for x in range(k + 1, j):
                        self.part[x] = "password" if 0 <= colon < x else "user"
                    break
                j += 1
            for x in range(j, n):
                if self.at[x] != self.at[x - 1] + len(self.toks[x - 1]):
                    break
                self.part[x] = self.part[x] or "host"

    def joins(self, k: int) -> str:
        """How a token of the chain follows the one before it."""
        i = self.chain.index(k)
        if not i:
            return "first"
        p = self.chain[i - 1]
        if self.at[k] == self.at[p] + len(self.toks[p]):
            return "glued"
        return "plus" if p == k - 4 and self.alone[k] and self.toks[k - 2] in ("+", ".") else "near" if k - p <= 6 else "far"

    def before(self, k: int) -> str:
        return self.toks[k - 1] if k else ""

    def after(self, k: int) -> str:
        return self.toks[k + 1] if k + 1 < len(self.toks) else ""

    def features(self, k: int) -> list[str]:
        t, f, names = self.toks[k], self.fams[k], self.names[k]
        n1, n2, n3 = names
        if f == "placeholder":
            return [f"f={f}"]
        size = len(t)
        kinds = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in t]
        # How often the kind of character changes: seldom in words and names, often in random matter.
        turns = min(5, int(10 * sum(a != b and a + b != "ul" for a, b in zip(kinds, kinds[1:], strict=False)) / size)) if size > 7 else 9
        where = self.part[k] or ("alone" if self.alone[k] else "quoted" if self.quoted[k] else "comment" if self.comment else "bare")
        out = [
            f"f={f}", f"f={f}|w={where}", f"f={f}|n1={n1}", f"f={f}|n1={n1}|n2={n2}", f"f={f}|n1={n1}|w={where}", f"n1={n1}", f"n2={n2}|f={f}", f"n3={n3}|f={f}",
            f"len={min(size // 4, 12)}|f={f}", f"b={self.before(k)[:3]}", f"a={self.after(k)[:3]}", f"b={self.before(k)[:3]}|f={f}", f"a={self.after(k)[:3]}|f={f}",
            f"n1={n1}|w={where}", f"n1={n1}|n2={n2}|w={where}", f"t={turns}|w={where}", f"t={turns}|n1={n1}", f"t={turns}", f"s={min(t.count('/'), 2)}|t={turns}",
            f"c={self.comment}|f={f}", f"w={where}", f"j={self.joins(k)}", f"j={self.joins(k)}|f={f}", f"pf={self.fams[k - 1] if k else 'start'}|f={f}",
        ]
        if f in ("word", "path"):  # told by the names before them and where they stand, not by what they are
            out = [x for x in out if f"f={f}" not in x or "n1" in x]
        if n1 == "plain" and self.alone[k]:  # a name that says nothing neither speaks for nor against
            out = [x for x in out if f"n1={n1}" not in x]
        if n1 == "auth":
            text = decoded(t) if self.toks[k - 1].lower() == "basic" else t
            out.append(f"auth={'bad' if text is None or PLACEHOLDER.search(text.split(':', 1)[-1]) else 'good'}|long={size >= 8}")
        digits = sum(c.isdigit() for c in t)
        out.append(f"mix={any(c.isupper() for c in t)}{any(c.islower() for c in t)}{min(digits, 3)}|n1={n1}")
        return out

    def cues(self) -> list[int]:
        """Labels of the sure places of the chain, OPEN for all others."""
        out: list[int] = []
        for k in self.chain:
            t, f, names = self.toks[k], self.fams[k], self.names[k]
            strong = f in STRONG
            if self.joins(k) in ("plus", "glued") and out[-1] != O:
                out.append(OPEN if out[-1] == OPEN else I)
            elif f == "placeholder" or self.comment and " must " in self.text:
                out.append(O)
            elif f == "keyblock" or self.part[k] == "password":
                out.append(B)
            elif self.part[k] in ("user", "host") and f != "known":
                out.append(O)
            elif names[0] == "auth":
                text = decoded(t) if self.before(k).lower() == "basic" else t
                out.append(B if (strong or f == "path") and not (text is not None and PLACEHOLDER.search(text.split(":", 1)[-1])) else O)
            elif f in ("known", "knownpart"):
                out.append(B)
            elif names[0] in ("reference", "digest", "placeholder") or f == "uuid":
                out.append(O)
            elif strong and names[0] == "secret":
                out.append(B)
            elif not strong and (SECRET_NAME.search(t) or not self.quoted[k] and any(c in self.text for c in "(){};")):
                out.append(O)  # a name, not a value
            elif strong and "secret" not in names and "-u" not in self.toks and not (self.alone[k] and f in ("long", "letters")):
                out.append(O)
            else:
                out.append(OPEN)
        return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def no_step() -> np.ndarray:
    step = np.zeros((3, 3))
    step[O, I] = BANNED
    return step


def cell(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SPACE


class Field:
    """A linear-chain conditional random field over hashed string features."""

    def __init__(self, weights: np.ndarray | None = None, step: np.ndarray | None = None):
        self.weights = np.zeros((SPACE, 3)) if weights is None else weights
        self.step = no_step() if step is None else step

    @staticmethod
    def rows(line: Line) -> list[list[int]]:
        return [[cell(f) for f in line.features(k)] for k in line.chain]

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((i for r in rows for i in r), dtype=np.int64)
        ends = np.cumsum([len(r) for r in rows])[:-1]
        return np.add.reduceat(self.weights[flat], np.concatenate([[0], ends]), axis=0)

    def viterbi(self, line: Line) -> list[int]:
        """Labels of the line's chain."""
        if not line.chain:
            return []
        e = self.emissions(self.rows(line))
        e[0, I] = BANNED
        at, back = e[0], []
        for row in e[1:]:
            through = at[:, None] + self.step
            back.append(through.argmax(0))
            at = through.max(0) + row
        best = [int(at.argmax())]
        for b in reversed(back):
            best.append(int(b[best[-1]]))
        return best[::-1]

    @classmethod
    def train(cls, lines: list[str], start: Field | None = None, epochs: int = EPOCHS, seed: int = 7) -> Field:
        """Maximum likelihood of the known labels with a small weight decay, by Adam over batches of lines, from ``start`` on."""
        data = []
        for x in map(Line, lines):
            labels = x.cues()
            if any(y != OPEN for y in labels):
                data.append((cls.rows(x), labels))
        w, a = (start.weights.copy(), start.step.copy()) if start else (np.zeros((SPACE, 3)), no_step())
        used = np.unique(np.fromiter((i for rows, _ in data for r in rows for i in r), dtype=np.int64))
        place = np.zeros(SPACE, dtype=np.int64)
        place[used] = np.arange(len(used))
        data = [([[place[i] for i in r] for r in rows], labels) for rows, labels in data]
        part = w[used]  # only the cells that occur here change
        moments = [np.zeros_like(part), np.zeros_like(part), np.zeros_like(a), np.zeros_like(a)]
        rng = np.random.default_rng(seed)
        tick = 0
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for lo in range(0, len(order), BATCH):
                gw, ga = np.zeros_like(part), np.zeros_like(a)
                for k in order[lo : lo + BATCH]:
                    cls._gradient(data[k], part, a, gw, ga)
                tick += 1
                for p, g, m, v in ((part, gw, moments[0], moments[1]), (a, ga, moments[2], moments[3])):
                    g = g / BATCH - 1e-4 * p
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p += RATE * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-8)
                a[O, I] = BANNED
        w[used] = part
        return cls(w, a)

    @staticmethod
    def _gradient(item: tuple, w: np.ndarray, a: np.ndarray, gw: np.ndarray, ga: np.ndarray) -> None:
        """Adds the features expected given the known labels, less those expected without them."""
        rows, labels = item
        flat = np.fromiter((i for r in rows for i in r), dtype=np.int64)
        sizes = [len(r) for r in rows]
        e = np.add.reduceat(w[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        e[0, I] = BANNED
        known = np.where([[y in (OPEN, s) for s in range(3)] for y in labels], e, 2 * BANNED)
        delta = np.zeros_like(e)
        for sign, x in ((1, known), (-1, e)):
            n = len(x)
            fwd, bwd = np.empty_like(x), np.zeros_like(x)
            fwd[0] = x[0]
            for t in range(1, n):
                fwd[t] = log_sum(fwd[t - 1][:, None] + a, 0) + x[t]
            for t in range(n - 2, -1, -1):
                bwd[t] = log_sum(a + (x[t + 1] + bwd[t + 1])[None, :], 1)
            z = log_sum(fwd[-1], 0)
            delta += sign * np.exp(fwd + bwd - z)
            if n > 1:
                ga += sign * np.exp(fwd[:-1, :, None] + a[None] + (x[1:] + bwd[1:])[:, None, :] - z).sum(0)
        np.add.at(gw, flat, np.repeat(delta, sizes, axis=0))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Character spans of the credentials of a line; parts of a split literal are one span each."""
        line = Line(text)
        out: list[tuple[int, int]] = []
        for k, label in zip(line.chain, self.viterbi(line), strict=True):
            if label == O:
                continue
            a, b = line.at[k], line.at[k] + len(line.toks[k])
            if label == I and out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out


Spans = list[tuple[int, int]]


def key_body(text: str, near_end: bool) -> tuple[int, int] | None:
    """Where the matter of a key block stands on one of its lines; (0, 0) on a blank one, None on other code."""
    m = KEY_LINE.match(text)
    if not m or not any(c.isalnum() for c in m["core"]):
        return None if m and m["core"].strip("\"'`+.,;)\\& #/*-") else (0, 0)
    if KEY_HEADER.fullmatch(m["core"]) or KEY_TEXT.fullmatch(m["core"]) and (near_end or len(m["core"]) >= 16):
        return m.span("core")
    return None


def continued(before: str, text: str) -> Spans:
    """Spans of the literals of ``text`` that continue a literal, given the rest of its line after the credential."""
    rest = GOES_ON.match(before)
    if not rest:
        return []
    if rest["open"]:
        m = OPEN_PART.match(text)
        return [m.span("part")] if m else []
    out: Spans = []
    at, joined = 0, rest["op"]
    while (m := GOING_ON.match(text, at)) and (not out or m["op"]) and not PLACEHOLDER.search(m["part"]):
        if not (joined or m["op"] or re.match(r"\s*[),;\]}]*\s*\\?$", text[m.end() :])):
            break
        out.append(m.span("part"))
        at, joined = m.end(), None
    return out


def carry(lines: list[str | None], spans: list[Spans]) -> tuple[list[Spans], list[bool]]:
    """Spans of each line of a snippet with what goes on from earlier lines, and whether a credential begins on it.

    ``spans`` are those of the lines alone. Lines not at hand are None; inside a block whose end is at hand they are skipped.
    """
    more: list[Spans] = [[] for _ in lines]

    def body(k: int, step: int, last: int) -> None:
        while 0 <= k < len(lines) and k != last:
            text = lines[k]
            if text is None and last < 0:
                return
            if text is not None:
                found = None if KEY_BEGIN.search(text) or KEY_END.search(text) else key_body(text, last >= 0 and k + 1 == last or step < 0 and k + 1 < len(lines) and bool(KEY_END.search(lines[k + 1] or "")))
                if found is None:
                    return
                if found[1]:
                    more[k].append(found)
            k += step

    for k, text in enumerate(lines):
        if text is None:
            continue
        open_at = None
        for m in sorted([*KEY_BEGIN.finditer(text), *KEY_END.finditer(text)], key=lambda m: m.start()):
            if m[0].startswith("-----BEGIN"):
                open_at = m
            elif open_at:
                if KEY_TEXT.fullmatch(re.sub(r"[\s\"'`+,]", "", text[open_at.end() : m.start()])):
                    more[k].append((open_at.end(), m.end()))
                open_at = None
            else:
                ended = next((j for j in range(k - 1, -1, -1) if lines[j] is not None and (KEY_BEGIN.search(lines[j]) or KEY_END.search(lines[j]))), None)
                if ended is None or KEY_END.search(lines[ended]):
                    body(k - 1, -1, -1)
                head = key_body(text[: m.start()], True) if text[: m.start()].strip() else None
                if head and head[1]:
                    more[k].append(head)
                if k and more[k - 1] or head and head[1]:
                    more[k].append(m.span())
        if open_at:
            rest = key_body(text[open_at.end() :], False)
            if rest and rest[1]:
                more[k].append((open_at.end() + rest[0], open_at.end() + rest[1]))
            ahead = next((j for j in range(k + 1, len(lines)) if lines[j] is not None and (KEY_BEGIN.search(lines[j]) or KEY_END.search(lines[j]))), -1)
            body(k + 1, 1, ahead if ahead >= 0 and KEY_END.search(lines[ahead]) else -1)
    for k in range(len(lines) - 1):
        here = [*spans[k], *more[k]]
        if here and lines[k] is not None and lines[k + 1] is not None and not KEY_BEGIN.search(lines[k]):
            more[k + 1] += continued(lines[k][max(b for _, b in here) :], lines[k + 1])
    begins = [any(not any(a < d and c < b for c, d in on) for a, b in own) for own, on in zip(spans, more, strict=True)]
    return [merged([*own, *on]) for own, on in zip(spans, more, strict=True)], begins


def merged(spans: Spans) -> Spans:
    out: Spans = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def bare(line: str) -> tuple[int, str]:
    """What ``clean_line`` leaves of a line, and where in the line it begins."""
    m = re.match(NUMBERED, line, re.ASCII)
    at = m.end() if m else 0
    text = re.sub("\r{1,2}$", "", line[at:]) if line.endswith("\r") else line[at:]
    return at + len(text) - len(text.lstrip(" ")), text.strip(" ")


def blank(snippet: str, known: dict[str, Spans]) -> str:
    """The snippet with an asterisk for each character of a credential, given the spans of single lines."""
    lines = snippet.split("\n")
    ats, texts = zip(*map(bare, lines), strict=True)
    for k, spans in enumerate(carry(list(texts), [known.get(t, []) for t in texts])[0]):
        for a, b in spans:
            a, b = a + ats[k], b + ats[k]
            lines[k] = lines[k][:a] + "*" * (b - a) + lines[k][b:]
    return "\n".join(lines)


def current_snippets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_id) of the current version of each finding, and (text_id, code_snippet) of each distinct snippet.

    Versions are settled on (id, time, text_id) alone; snippets are folded where they are read, so a text goes over the
    network once for each task that holds it. Of two versions of one time both count. A null snippet has a null text_id.
    """
    raw = table(spark, sf_dir, "findings").select(clean_id("id").alias("id"), "ingested_at", F.md5("code_snippet").alias("text_id"), "code_snippet")
    last = raw.groupBy("id").agg(F.max("ingested_at").alias("ingested_at"))
    rows = raw.select("id", "ingested_at", "text_id").join(last, ["id", "ingested_at"], "left_semi").select("id", "text_id").distinct()
    texts = raw.filter(F.col("code_snippet").isNotNull()).groupBy("text_id").agg(F.first("code_snippet").alias("code_snippet"))
    return rows, texts


def candidate_lines(texts: DataFrame) -> DataFrame:
    """text_id, snippet_line, line: lines of the snippets that could hold a credential."""
    lines = texts.select("text_id", F.posexplode(F.split("code_snippet", "\n")).alias("pos", "line"))
    return lines.select("text_id", (F.col("pos") + 1).alias("snippet_line"), clean_line(F.col("line")).alias("line")).filter(F.col("line").rlike(CANDIDATE))


def clean_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, "\r$", ""), NUMBERED, ""))


def fit(lines: DataFrame, bound: int = TRAIN_LINES) -> Field:
    """Train on about ``bound`` distinct lines, those in a range of hashes, in ``PARTS`` tasks.

    Each part fits the field on its lines from the average of the round before; only weights reach the driver.
    """
    many = max(1, lines.agg(F.approx_count_distinct("line")).first()[0])
    part = min(1.0, bound / many)
    low = F.xxhash64("line") <= int(-(2**63) + part * (2**64 - 1)) if part < 1 else F.lit(True)
    sample = materialise(lines.filter(low).select("line").distinct().repartition(PARTS, "line").sortWithinPartitions("line"), "training-lines")
    field = Field()
    for turn in range(ROUNDS):
        shared = lines.sparkSession.sparkContext.broadcast(field)

        def run(batches: Iterator[pd.DataFrame], shared=shared, turn=turn) -> Iterator[pd.DataFrame]:
            mine = [x for pdf in batches for x in pdf["line"]]  # a part of the bounded sample
            if mine:
                own = Field.train(mine, shared.value, seed=7 + turn)
                some = np.flatnonzero(own.weights.any(1))
                cells = np.concatenate([some, SPACE + np.arange(3)])
                yield pd.DataFrame(np.column_stack([cells, np.concatenate([own.weights[some], own.step])]), columns=["cell", "o", "b", "i"]).astype({"cell": "int32"})

        fitted = sample.mapInPandas(run, "cell int, o double, b double, i double")
        sums = fitted.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "obi"], F.count(F.lit(1)).alias("n")).toPandas()
        weights, step = np.zeros((SPACE, 3)), np.zeros((3, 3))
        # A cell is averaged over the parts that know it, so rare features keep their weight.
        mean = sums[["o", "b", "i"]].to_numpy() / sums[["n"]].to_numpy()
        at = sums["cell"].to_numpy()
        weights[at[at < SPACE]] = mean[at < SPACE]
        step[at[at >= SPACE] - SPACE] = mean[at >= SPACE]
        field = Field(weights, step)
    return field


def label_lines(lines: DataFrame, field: Field) -> DataFrame:
    """line, starts, ends of every distinct line that holds a credential or ends a key block (without spans, if it holds none)."""
    shared = lines.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, [a for a, _ in sp], [b for _, b in sp]) for s in pdf["line"] if (sp := shared.value.spans(s)) or KEY_END.search(s)]
            yield pd.DataFrame(rows, columns=["line", "starts", "ends"])

    return lines.select("line").distinct().mapInPandas(run, "line string, starts array<int>, ends array<int>")


def labelled(texts: DataFrame) -> DataFrame:
    """text_id, parts: the labelled lines (snippet_line, line, starts, ends) of each snippet that has any."""
    lines = materialise(candidate_lines(texts), "candidate-lines")
    found = lines.join(label_lines(lines, fit(lines)), "line")
    return found.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("snippet_line", "line", "starts", "ends"))).alias("parts"))


def beginnings(parts: list) -> list[int]:
    """Numbers of the lines on which a credential begins."""
    at = [p["snippet_line"] for p in parts]
    lines, spans = [None] * max(at), [[] for _ in range(max(at))]
    for p in parts:
        lines[p["snippet_line"] - 1], spans[p["snippet_line"] - 1] = p["line"], list(zip(p["starts"], p["ends"], strict=True))
    return [k for k, begins in enumerate(carry(lines, spans)[1], 1) if begins]


def find_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, snippet_line: each line of a current finding on which a credential begins."""
    rows, texts = current_snippets(spark, sf_dir)
    begin = F.pandas_udf(lambda parts: parts.map(beginnings), "array<int>")
    found = labelled(texts).select("text_id", begin("parts").alias("at"))
    return rows.join(found, "text_id").select("id", F.explode("at").alias("snippet_line")).distinct()


def redacted_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, code_snippet: every current finding, its credentials blanked where they stand, all else unchanged."""
    rows, texts = current_snippets(spark, sf_dir)
    texts = materialise(texts, "snippets")
    joined = texts.join(labelled(texts), "text_id", "left")

    def run(snippets: pd.Series, parts: pd.Series) -> pd.Series:
        none: list = []
        return pd.Series([
            None if s is None else blank(s, {p["line"]: list(zip(p["starts"], p["ends"], strict=True)) for p in (none if ps is None else ps)})
            for s, ps in zip(snippets, parts, strict=True)
        ], dtype=object)

    touched = F.col("parts").isNotNull() | F.col("code_snippet").contains("-----END")
    done = F.pandas_udf(run, "string")(F.when(touched, F.col("code_snippet")), F.col("parts"))
    blanked = joined.select("text_id", F.when(touched, done).otherwise(F.col("code_snippet")).alias("code_snippet"))
    return rows.join(blanked, "text_id", "left").select("id", "code_snippet")


def redact(line: Column, starts: Column, ends: Column) -> Column:
    """The line with each span replaced by as many asterisks; everything else is unchanged."""
    return F.aggregate(
        F.arrays_zip(starts.alias("a"), ends.alias("b")), line,
        lambda s, p: F.overlay(s, F.repeat(F.lit("*"), p["b"] - p["a"]), p["a"] + 1, p["b"] - p["a"]),
    )
