"""Problem 5: credentials in source code and configuration.

Literals that stand in an assignment context (an assigned name, a key, a header, a URL, a call or a comment that speaks of a
password) are segmented into dictionary words by Viterbi; what no word explains is the residual.  A literal with enough of it
is a credential, unless it has the form of a placeholder or of a known hash.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lintlake.llm.tokenize import TOKENIZERS, VOCABULARY, ranks

#: Unexplained characters that make a literal a credential after a credential's name, and elsewhere.
NEAR, FAR = 2, 8

#: Characters in which a cast or a copying call and the quote after it fit.
CAST = 80
_BLANKS = re.compile(r"\s*")

#: Words of names that hold a credential (fixed values).
_SURE = """password passwd passwort pass pwd pw passphrase passcode secret token tok bearer apikey psk credential credentials cred creds jwt
contrasena clave kennwort pin otp""".split()
_KEYED = "api access signing sign svc service secret private priv auth encryption encrypt client shared master account storage session license x deploy hmac aes".split()
#: Last words of names that only speak about a credential (fixed values).
_ABOUT = """env name var variable file filename path dir len length size count max min fmt format hash hashed digest sha sha1 sha256 sha512 md5 crc checksum
url uri prompt hint label expiry ttl timeout type header field index idx id pattern regex policy fingerprint version public pub cert certificate map list
stage slot page limit bits bytes error err msg message text help test kind mode state enum""".split()
#: Beginnings of keys that are known as they stand, functions that compare and that log in, and words before an account (fixed values).
_PREFIXES = "akia asia gh[pousr]_ github_pat_ sk_live_ xox[bapr]- aiza glpat-".split()
_COMPARES = "strcmp strncmp strcasecmp memcmp equals compare_digest".split()
_LOGINS = "connect login logon authenticate auth set_?credentials signin sign_in open_session basic_auth".split()
_ACCOUNTS = ["login", "log in", "user(?:name)?", "account", "anmeldung", "acceso", "usuario"]
_WORDS = "|".join(dict.fromkeys([*_SURE, "api", "auth", "contrase", "密码", "口令", "private key", *_PREFIXES, *_COMPARES, *_LOGINS]))
#: Read on lower-cased text, together a superset of what the detectors begin with; one pattern for each kind is faster than all in one.
_TRIGGERS = [re.compile(p) for p in (_WORDS, rf"(?:{'|'.join(_ACCOUNTS)})(?!\w)", "keys?(?![a-z])", "sig(?![a-z])", "(?:signature|code)=", r"://[^\s:/@\"']*:")]
_STRUCTS = re.compile(r"struct\b[^{};\n]*(?:[{\n]|\Z)")
_PLACE = re.compile(
    r"""^(?:|[%$].?|%[-+#0-9.lhzjt]*[a-z]|\$\{?\w+\}?|\$\(\w+\)|%\w+%|<[^<>]*>|\[[^\[\]]*\]|\{\{?[^{}]*\}?\}|@\w+@|__\w+__|[*xX.•_\-?#]{2,}|(?:your|my|the|some|enter|insert|put|replace|set|add)[-_ ]?.*|(?:change|fill|todo|tbd|fixme)[-_ ]?.*
    |(?:none|null|nil|true|false|yes|no|on|off|void|undefined|unset|empty|redacted|masked|hidden|removed|example|sample|dummy|test|fake|placeholder|default|secret|password|passwd|token|changeme|string|n/?a)[\d!]{0,2})$""",
    re.I | re.X,
)
_HASH = re.compile(r"^(?:\$(?:2[abxy]|1|5|6|argon2\w*|pbkdf2[\w-]*)\$.*|\{S?SHA\d*\}.*|(?:sha\d*|md5|crc32)[-:=].*|pbkdf2:.*|(?:[0-9a-f]{2}:){5,}[0-9a-f]{2})$", re.I)
_UUID = re.compile(r"^\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}?$", re.I)
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|sk_live_[A-Za-z0-9]{16,}|xox[bapr]-[A-Za-z0-9-]{16,}|AIza[\w-]{35}|glpat-[\w-]{20})(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: What follows an opening mark without END: lines of base64 and headers of the block, in quotes, comments or escapes.
_PEM_RUN = re.compile(r"""(?:(?:[ \t]|\\[nrt]|["'\\,+#*/;]|\r?\n)*(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n"\\]*|[A-Za-z0-9+/]{16,}+={0,2}(?![\w(.\-])|[A-Za-z0-9+/]++={1,2}(?=\W|\Z)|(?=[a-z]*[A-Z0-9+/])[A-Za-z0-9+/]{1,63}(?=["'\\ \t,;]*(?:\r?\n|\Z))))*""")
_STR = r"""(?:(?:\b[bBrRuULf]{1,2}|u8)?(?:"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'))"""
_ADJACENT = re.compile(rf"(?:{_STR})(?:(?:[ \t]*\\?\n)?[ \t]*{_STR})*")
_PIECE = re.compile(r"""["']((?:[^"'\\\n]|\\[\s\S]|(?<=\w)'(?=\w))*)["']""")
#: name, then = or :, then a literal (perhaps within a cast, a call that copies it, or a bracket)
_ASSIGN = re.compile(
    r"""(?P<name>[A-Za-z_][\w.\-]*)(?P<close>\\?["']?\s*\]?\)?(?:\s*\[[^\]\n]*\])?)\s*(?P<op>:?=(?!=)|:(?!:|//)|=>|\s(?=["']))[ \t]*\\?\n?[ \t]*(?:\([^()\n]{0,40}\)\s*)?(?:(?:strdup|str|bytes|String|std::string)\s*\(\s*)?(?=\\?["']|\{|\()""",
    re.X,
)
_ESCAPED = re.compile(r"""\\(["'])(?P<name>[A-Za-z_][\w.\-]*)\\\1\s*:\s*\\(["'])(?P<value>(?:[^"'\\\n]|\\[^"'\n])*)\\\3""")
_PAIR = re.compile(rf"""["'](?P<name>[A-Za-z_][\w.\-]*)["']\s*,\s*(?={_STR})""")
_BARE = re.compile(r"""(?P<name>[A-Za-z_][\w.\-]*)[ \t]*(?P<op>:=|=(?!=)|:(?!:|//))[ \t]*(?P<value>[^\s"'{(\[,;][^\s"']*)""")
_SPOKEN = re.compile(r"""(?i)\b(?P<name>pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|(?:api|access)[ _-]?key|psk|passwort|kennwort|contraseña|clave|密码|口令)\b["']?\s*(?:(?:is|was|now|are|ist|war|lautet|es|era)\b|[=:]|是|为|：)\s*["'`]?(?P<value>[^\s"'`,;]+)""")
_LOGIN = re.compile(rf"""(?i)\b(?:{'|'.join(_ACCOUNTS)})\b(?: as| with|:)?\s+["'`]?[\w.@-]+["'`]?\s*(?:/|:|,| with | and | mit | con )\s*["'`]?(?P<value>[^\s"'`,;]+)""")
_URL = re.compile(r"""[a-zA-Z][a-zA-Z0-9+.\-]*://(?P<user>[^\s:/@"'<>]*):(?P<value>[^\s/"'<>]*?)@(?=[\w\[%$])""")
_PARAM = re.compile(r"""(?i)[?&;](?P<name>[\w.\-]*(?:key|sig|signature|token|secret|pass(?:word|wd)?|pwd|auth|code|apikey))=(?P<value>[^\s&"'<>#]+)""")
_HEADER = re.compile(r"""(?i)\b(?:proxy-)?authorization["']?\s*[:=,]\s*["']?\s*(?P<kind>bearer|basic|token|digest|apikey)\s+(?P<value>[^\s"'<>\\(),;]+)""")
_XHEADER = re.compile(r"""(?i)\b(?P<name>X-[\w\-]*(?:key|token|secret|auth|pass(?:word)?)|api-key|x-auth)["']?\s*[:=]\s*["']?(?P<value>[^\s"'<>\\]+)""")
_COMPARE = re.compile(rf"""\b(?:{'|'.join(_COMPARES)})\s*\(\s*(?:[^()"'\n,]+,\s*(?={_STR})|(?={_STR}\s*,))""")
_CALL = re.compile(rf"""(?i)\b\w*(?:{'|'.join(_LOGINS)})\w*\s*\((?P<args>[^;{{}}\n]*)""")
_LOGS_IN, _SPEAKS_OF_ACCOUNT = re.compile("|".join(_LOGINS)), re.compile("|".join(_ACCOUNTS))
_ARRAY = re.compile(r"""(?P<name>[A-Za-z_]\w*)\s*\[[^\]\n]*\]\s*=\s*(?:\(?\s*)?\{(?P<body>[^{}]*)\}""")
_BYTES = re.compile(r"0[xX][0-9A-Fa-f]{1,2}\b|\b\d{1,3}\b|'(?:[^'\\\n]|\\.)'")
_PYBYTES = re.compile(r"""(?P<name>[A-Za-z_]\w*)\s*[:=]\s*(?:bytes|bytearray)\s*\(\s*\[(?P<body>[^\[\]]*)\]""")
_ARRAY_NAME, _PYBYTES_NAME = re.compile(r"[A-Za-z_]\w*(?=\s*\[)"), re.compile(r"[A-Za-z_]\w*(?=\s*[:=]\s*(?:bytes|bytearray)\s*\()")
_STRUCT = re.compile(r"struct\b[^{};]*\{(?P<fields>[^{}]*)\}[^={};]*=\s*\{(?P<values>[^{}]*)\}")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


@lru_cache(1)
def _dictionary(path: str) -> tuple[dict[str, float], int]:
    """Words of the public vocabulary with their cost, and the length of the longest; the vocabulary is ordered by how common its entries are."""
    out: dict[str, float] = {}
    for word, rank in ranks(path).items():
        w = word.decode("utf-8", "ignore").strip().lower()
        if len(w) >= 3 and w.isalpha() and w.isascii():
            out.setdefault(w, 3 + math.log(rank + 10))
    return out, max(map(len, out), default=0)


@lru_cache(100_000)
def residual(literal: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> int:
    """Letters and digits of the literal that the cheapest segmentation leaves unexplained."""
    (words, longest), n = _dictionary(path), len(literal)
    low = literal.lower()
    best, left = [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        c = low[i - 1]
        free = not c.isalnum()
        best[i], left[i] = best[i - 1] + (1.0 if free else 6.0), left[i - 1] + (not free)
        for k in range(3, min(i, longest) + 1):
            cost = words.get(low[i - k : i])
            if cost is not None and best[i - k] + cost < best[i]:
                best[i], left[i] = best[i - k] + cost, left[i - k]
    return left[n]


@lru_cache(50_000)
def speaks(name: str) -> bool:
    """Whether a name is one that holds a credential."""
    parts = [p for p in (x.lower() for x in _SPLIT.split(name)) if p]
    if not parts or parts[-1] in _ABOUT:
        return False
    if any(p in _SURE for p in parts) or any(p.endswith(("password", "passwd", "secret", "apikey", "passphrase")) for p in parts):
        return True
    if parts[-1] in ("key", "keys") and any(p in _KEYED for p in parts[:-1]):
        return True
    return parts[-2:] == ["x", "api"] or parts[-1:] == ["sig"]


def _classes(v: str) -> int:
    return any(c.islower() for c in v) + any(c.isupper() for c in v) + any(c.isdigit() for c in v) + any(not c.isalnum() for c in v)


def plausible(value: str, least: int, sure: bool) -> bool:
    """Whether a literal can be a credential: no placeholder, no prose, no hash format, and enough that no word explains."""
    v = value.strip()
    if len(v) < 4 or _PLACE.match(v) or _HASH.match(v) or re.search(r"\s", v) or "%s" in v or re.search(r"\$\{|\{\w*\}|<\w+>|\.(?:pem|key|crt|txt|json|ini|h|c|py)$", v):
        return False
    if len(set(v)) < 4 or v.isdigit() and len(v) < 8:
        return False
    if re.fullmatch(r"(?:[A-Z]+_)+[A-Z]+\d?|/[\w./-]+|[\w-]+(?:\.[\w-]+)*\.(?:invalid|com|org|net|local|example)(?:[:/].*)?", v):
        return False  # the name of a variable, a path, a host
    if re.match(r"[A-Za-z_][\w.>-]*[\[(]", v):
        return False  # an expression
    if not sure and (_UUID.match(v) or re.fullmatch(r"[A-Za-z_]+", v)):
        return False
    return residual(v) >= least and _classes(v) >= 2


class _Finder:
    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> None:
        """Adds a span; spans that overlap become one."""
        if end > start:
            i, j = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
            if i < j:
                start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
            self.starts[i:j], self.ends[i:j] = [start], [end]

    def literal(self, at: int, least: int, sure: bool) -> bool:
        """Adds the literal (or the adjacent literals) at this place, if it can be a credential."""
        m = _ADJACENT.match(self.text, at)
        if not m:
            return False
        pieces = [(x.start(1), x.end(1)) for x in _PIECE.finditer(self.text, m.start(), m.end())]
        value = "".join(self.text[a:b] for a, b in pieces)
        if re.fullmatch(r"(?:\\x[0-9a-fA-F]{2})+", value):
            value = value.replace("\\x", "")
        if not pieces or not plausible(value, least, sure):
            return False
        self.add(pieces[0][0], pieces[-1][1])
        return True


def _pem(text: str, at: int) -> tuple[bool, int]:
    """Whether a key block whose opening mark ends here has its END mark, and where its body ends: there, at the next BEGIN, or where the lines of base64 end."""
    end, begin = _PEM_END.search(text, at), text.find("-----BEGIN", at)
    if end and not 0 <= begin < end.start():
        return True, end.start()
    return False, _PEM_RUN.match(text, at, begin if begin >= 0 else len(text)).end()


def _line(text: str, at: int) -> tuple[int, int]:
    a = text.rfind("\n", 0, at) + 1
    b = text.find("\n", at)
    return a, len(text) if b < 0 else b


def find(text: str) -> list[tuple[int, int]]:
    """Start and end of the value of each credential."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case; places must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    lines = {low.rfind("\n", 0, t.start()) + 1 for pattern in _TRIGGERS for t in pattern.finditer(low)}
    structs = {low.rfind("\n", 0, t.start()) + 1 for t in _STRUCTS.finditer(low)}
    if not lines and not structs:
        return []
    f = _Finder(text)
    for a in sorted(lines | structs):
        b = _line(text, a)[1]
        struct = a in structs and _in_struct(f, text, a, b)
        if a in lines:
            _in_line(f, text, low[a:b], a, b, struct)
    return list(zip(f.starts, f.ends, strict=True))


def _in_struct(f: _Finder, text: str, a: int, b: int) -> bool:
    """Whether a structure with its values begins on the line; its fields that hold credentials are added."""
    struct = next((x for m in re.finditer(r"struct\b", text[a:b]) if (x := _STRUCT.match(text, a + m.start()))), None)
    if struct is None:
        return False
    names = re.findall(r"[\s*](\w+)\s*(?=[,;])", struct["fields"])
    values = [m.start() for m in _ADJACENT.finditer(text, struct.start("values"), struct.end("values"))]
    for name, at in zip(names, values, strict=False):
        if speaks(name):
            f.literal(at, NEAR, True)
    return True


def _in_line(f: _Finder, text: str, line: str, a: int, b: int, struct: bool) -> None:
    """Looks at one line, text[a:b]; line is the same in lower case; the members of a structure are not assignments."""
    if "private key" in line:
        blocks = 0
        for m in _PEM.finditer(text, a, b):
            closed, end = _pem(text, m.end())
            if len(re.sub(r"[^A-Za-z0-9+/=]", "", text[m.end() : end])) >= 40:
                f.add(m.start(), _PEM_END.match(text, end).end() if closed else end)
                blocks += 1
        if blocks:
            return
    for m in _KNOWN.finditer(text, a, b):
        if "EXAMPLE" not in m[0]:
            f.add(m.start(), m.end())
    if "://" in line and "@" in line:
        for m in _URL.finditer(text, a, b):
            v = m["value"]
            if v and not _PLACE.match(v) and "%s" not in v and not re.search(r"\$\{|\{\w*\}", v):
                f.add(m.start("value"), m.end("value"))
    if "=" in line and ("?" in line or "&" in line or ";" in line):
        _values(f, _PARAM, text, a, b, FAR)
    if "authorization" in line:
        for m in _HEADER.finditer(text, a, b):
            v = m["value"]
            if m["kind"].lower() == "basic":
                try:
                    plain = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode()
                except (binascii.Error, ValueError):
                    continue
                if ":" in plain and not _PLACE.match(plain.partition(":")[2]):
                    f.add(m.start("value"), m.end("value"))
            elif plausible(v, FAR, True):
                f.add(m.start("value"), m.end("value"))
    if "x-" in line or "api-key" in line:
        _values(f, _XHEADER, text, a, b, FAR)
    quoted = '"' in line or "'" in line
    if struct:
        return
    # a value may stand on the next line, after any number of blanks and a cast
    for m in _ASSIGN.finditer(text, a, min(len(text), _BLANKS.match(text, b).end() + CAST)):
        if m.start() < b and speaks(m["name"]) and text[m.end() : m.end() + 1] not in ("{", "("):
            f.literal(m.end(), NEAR, True)
    if quoted:
        if "\\" in line:
            for m in _ESCAPED.finditer(text, a, b):
                if speaks(m["name"]) and plausible(m["value"], NEAR, True):
                    f.add(m.start("value"), m.end("value"))
        for m in _PAIR.finditer(text, a, b):
            if speaks(m["name"]):
                f.literal(m.end(), NEAR, True)
        if "cmp" in line or "equals" in line or "compare" in line:
            for m in _COMPARE.finditer(text, a, b):
                lit = _ADJACENT.match(text, m.end())
                v = lit[0].strip("\"'") if lit else ""
                if len(re.findall(r"\d", v)) >= 2 and _classes(v) >= 2 or _classes(v) >= 3:
                    f.literal(m.end(), 3, False)
        if "(" in line and _LOGS_IN.search(line):
            for m in _CALL.finditer(text, a, b):
                lits = list(_ADJACENT.finditer(text, m.start("args"), m.end("args")))
                if len(lits) >= 2 and (re.search(r"\d", lits[-1][0]) or _mixed(lits[-1][0].strip("\"'"))):
                    f.literal(lits[-1].start(), 3, False)
    if "[" in line:
        for pattern, name in ((_ARRAY, _ARRAY_NAME), (_PYBYTES, _PYBYTES_NAME)):
            for n in name.finditer(text, a, b):
                if speaks(n[0]) and (m := pattern.match(text, n.start())):
                    items = list(_BYTES.finditer(text, m.start("body"), m.end("body")))
                    if len(items) >= 8 and len({x[0] for x in items}) >= 4:
                        f.add(items[0].start(), items[-1].end())
    if "=" in line or ":" in line:
        for m in _BARE.finditer(text, a, b):
            if not speaks(m["name"]):
                continue
            head, v = text[a : m.start()], m["value"].rstrip(",;")
            if head.count('"') % 2 or head.count("'") % 2 or head.strip() and not re.search(r"(?:^|\s)(?:#|//|/\*|\*|;|--|export|set|env)\s*(?:\w+\s+)?$", head, re.I):
                continue
            if not re.search(r"[()]", v) and (head.strip() or not m["value"].endswith(";")) and plausible(v, NEAR, True):
                f.add(m.start("value"), m.start("value") + len(v))
    for m in _SPOKEN.finditer(text, a, b):
        v = m["value"].rstrip(".)")
        if (not re.fullmatch(r"[A-Za-z-]+", v) or _mixed(v)) and "(" not in v and plausible(v, NEAR, True):
            f.add(m.start("value"), m.start("value") + len(v))
    if _SPEAKS_OF_ACCOUNT.search(line):
        for m in _LOGIN.finditer(text, a, b):
            v = m["value"].rstrip(".)")
            if (re.search(r"\d", v) or _mixed(v)) and "(" not in v and plausible(v, NEAR, True):
                f.add(m.start("value"), m.start("value") + len(v))


def _mixed(v: str) -> bool:
    """Small and capital letters, and not as in a name."""
    return _classes(v) >= 2 and bool(re.search("[a-z][A-Z]|[A-Z]{2}[a-z]", v)) and len(v) >= 8


def _values(f: _Finder, pattern: re.Pattern, text: str, a: int, b: int, least: int) -> None:
    for m in pattern.finditer(text, a, b):
        if plausible(m["value"], least, True):
            f.add(m.start("value"), m.end("value"))


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the credentials' characters replaced; quotes, commas, line ends and the lengths of all lines stay."""
    out, at = [], 0
    for s, e in spans:
        value = text[s:e]
        if _BYTES.match(value) and "," in value:
            value = _BYTES.sub(lambda m: "0x" + "0" * (len(m[0]) - 2) if m[0][:2].lower() == "0x" else "'*'" if m[0][0] == "'" else "0" * len(m[0]), value)
        elif value.startswith("-----BEGIN"):
            head, tail = _PEM.match(value), _PEM_END.search(value)
            stop = tail.start() if tail else len(value)
            value = head[0] + re.sub(r"(?<!\\)[A-Za-z0-9+/=]", "*", value[head.end() : stop]) + value[stop:]
        else:
            value = re.sub(r"(?P<k>[\"'][ \t]*\\?\n?[ \t]*(?:u8|[bBrRuUL]{1,2})?[\"'])|[\s\S]", lambda m: m["k"] or ("\n" if m[0] == "\n" else "*"), value)
        out += [text[at:s], value]
        at = e
    return "".join([*out, text[at:]])


def _scan(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines, kept, texts = [], [], [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("source_text").to_pylist(), strict=True):
                spans = find(text) if text else []
                if with_text:
                    kept.append(i)
                    texts.append(mask(text, spans) if spans else text)
                else:
                    for s, _ in spans:
                        ids.append(i)
                        lines.append(text.count("\n", 0, s) + 1)
            if with_text:
                yield pa.record_batch({"file_id": pa.array(kept, pa.string()), "redacted_text": pa.array(texts, pa.string())})
            else:
                yield pa.record_batch({"file_id": pa.array(ids, pa.string()), "line_no": pa.array(lines, pa.int32())})

    return run


def find_secrets(files: DataFrame) -> DataFrame:
    """(file_id, line_no): the line on which the value of each credential begins, once per file and line.

    Null ids and null texts give no row; rows given twice count once; other columns are ignored.
    """
    df = files.select("id", "source_text").where("id IS NOT NULL AND source_text IS NOT NULL")
    return df.mapInArrow(_scan(False), "file_id string, line_no int").distinct()


def redact(files: DataFrame) -> DataFrame:
    """(file_id, redacted_text), one row an id: the text with each credential masked and all else unchanged; null stays null.

    Null ids give no row; rows given twice come out once.
    """
    return files.select("id", "source_text").where("id IS NOT NULL").mapInArrow(_scan(True), "file_id string, redacted_text string").dropDuplicates(["file_id"])
