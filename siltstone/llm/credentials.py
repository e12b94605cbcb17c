"""Credentials embedded in source code: a linear-chain conditional random field over lexical tokens.

A line is cut into lexical tokens (string contents, values of assignments, parts of URLs, words, punctuation). Each token has
shape features (what it looks like) and context features (the key it is assigned to, its neighbours, where it stands); the
chain's weights are trained on generated lines (``train_credentials``) and kept in ``credentials_weights.json``. Viterbi spans
say which literal characters are redacted: only those, so quotes, commas and brackets around them stay. Lines without any
word, prefix or URL form that the features know a credential by are not decoded: the gate holds every form of the same
lists. It is needed, as the chain was not trained on other lines and takes quantities such as "306Mi" in them for credentials.

Private keys of several lines are one literal from their BEGIN line to their END line, however far; without an END (cut off at
a chunk's end, or another BEGIN comes first) to the last of the lines below that look like a key's.
"""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = Path(__file__).with_name("credentials_weights.json")
LINE_END = re.compile(r"\r\n|\n|\r")
#: Parts of the names that hold credentials, settings about them, and digests.
SENSITIVE = ("password", "passwd", "passphrase", "passcode", "pwd", "pw", "secret", "token", "apikey", "api_key", "accesskey", "access_key", "privatekey", "private_key", "signingkey", "signing_key", "deploykey", "deploy_key", "encryptionkey", "encryption_key", "secretkey", "secret_key", "authkey", "auth_key", "credential", "credentials", "auth", "licence", "license", "bearer", "connectionstring", "account_key", "master_key", "session_key", "webhook", "x_api_key", "pat")
ABOUT = ("file", "path", "dir", "header", "length", "len", "days", "day", "min", "max", "count", "size", "name", "id", "type", "field", "prefix", "suffix", "policy", "rotation", "ttl", "hint", "env", "var", "expiry", "expires", "timeout", "limit", "enabled", "required", "url", "uri", "endpoint", "version", "mode", "format", "regex", "pattern", "table", "map", "defaults", "window", "item", "weight", "seen", "cost", "rounds", "scope", "ref", "column", "label", "provider", "store", "manager", "service", "algorithm")
DIGEST = ("sha", "sha1", "sha256", "sha512", "md5", "checksum", "digest", "hash", "etag", "commit", "integrity", "fingerprint", "uuid", "guid", "trace", "revision", "rev", "icon", "image", "public", "publickey", "public_key", "session_ref", "ref", "build", "signature", "crc", "blob", "thumbprint", "request_id", "trace_id", "correlation")
NEEDLES = ("pass", "pwd", "_pw", "pw ", "pw\"", "pw:", "pw=", "secret", "token", "key", "cred", "auth", "bearer", "basic ", "licen", "login", "log in", "account", "private key", "akia", "asia", "eyj", "ghp_", "gho_", "ghs_", "github_pat", "glpat", "xox", "sk-", "sk_", "pk_", "rk_", "_pat_", "_live_", "_test_", "_prod_", "aiza", "sig=", "remove:", "conn", "webhook", "signing")

_URL = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*://)([^\s:/@\"'`<>]*):([^\s\"'`@/]+|[^\s\"'`@]+)@(?=[\w.\[-])")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_LEX = re.compile(
    r"(?P<pem>-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:\\n.*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:\\n)*|\\n[^\"'`\s]*)?)"
    r"|(?P<mark>-----(?:BEGIN|END)[A-Z0-9 ]+-----)"
    r"|(?P<scheme>[A-Za-z][A-Za-z0-9+.\-]*://)(?P<user>[^\s:/@\"'`<>]*)(?P<colon>:)(?P<pass>\$?\{\{?[^}\s]*\}\}?|\$\([^)\s]*\)|<[^>\s]*>|[^\s\"'`@/]+)(?=@[\w.\[-])"
    r"|(?P<str>(?<=\")[^\"\s]+(?=\")|(?<=')[^'\s]+(?=')|(?<=`)[^`\s]+(?=`))"
    r"|(?P<ref>\$\{\{?[^}]*\}?\}|\$\([^)]*\)|\{\{[^}]*\}\}|<[\w .-]+>|%[A-Z_]+%)"
    r"|(?P<call>[A-Za-z_][\w.]*(?=[(\[]))"
    r"|(?P<num>\d+(?:\.\d+)?(?![\w+/=@!?$%&*^~#.-]))"
    r"|(?P<key>(?!(?=\w*\d)(?=\w*[A-Z])(?=\w*[a-z])\w{12,}={1,2}(?:[\s\"'`]|$))[A-Za-z_][\w.\-]*(?=\s*(?::=|\?\?=|=>|[=:])))"
    r"|(?P<op>:=|\?\?=|=>|->|==|!=|[=:+,;()\[\]{}<>|&])"
    r"|(?P<q>[\"'`])"
    r"|(?P<word>[^\s\"'`,;()\[\]{}<>|=:]+(?:={1,2}(?=[\s\"'`]|$))?)"
)
#: Options of command lines whose value is a password, written to a flag or behind it; programs and flags are fixed values.
_ARGUMENT = r"(?!\$|-)[^\s'\"`|;<>]+"
_OPTION = re.compile(
    rf"\b(?:(?:mysql|mariadb)[\w-]*\s(?:[^|;&\r\n]*?\s)?(?P<f1>-p)(?P<v1>{_ARGUMENT})|curl\s(?:[^|;&\r\n]*?\s)?(?P<f2>-u|--user|-U|--proxy-user)[ =]?['\"]?[\w.@+-]+:(?P<v2>{_ARGUMENT})"
    rf"|redis-cli\s(?:[^|;&\r\n]*?\s)?(?P<f3>-a)\s+['\"]?(?P<v3>{_ARGUMENT})|ldap[a-z]+\s(?:[^|;&\r\n]*?\s)?(?P<f4>-w)\s+['\"]?(?P<v4>{_ARGUMENT}))"
)
_PROGRAMS = ("mysql", "mariadb", "curl", "redis-cli", "ldap")
#: A connection string: names and values, parted by semicolons or ampersands.
_PAIRS = re.compile(r"[A-Za-z_][\w.\-]*=[^;]*(?:;[A-Za-z_][\w.\-]*=[^;]*)+;?|[A-Za-z_][\w.\-]*=[^&;]*(?:&[A-Za-z_][\w.\-]*=[^&;]*)+")
_VALUE = re.compile(r"[^\s\"'`,;()\[\]{}<>]+")
_TRAIL = re.compile(r"[.,;:]+$")
_PLACE = re.compile(
    r"(?i)^(?:$|<.*>|\$\{.*|\$\(.*|\$[A-Z_]+$|\{\{.*|%.*%$|\*{3,}.*|x{4,}$|\.{2,}$|-+$|_+$|(?:your|my|some|insert|put|enter|add|the|a|an)[-_ ].*|change[-_]?me.*|replace.*|to[-_]?do.*|tbd$|fix[-_]?me.*|"
    r"dummy.*|fake.*|example.*|sample.*|placeholder.*|redacted.*|masked.*|hidden.*|removed.*|none$|null$|nil$|true$|false$|undefined$|empty$|n/?a$|test$|password$|secret$|token$|foo(?:bar)?$|bar$|xxx.*|\[.*\]$|0+$|1234.*$)"
)
_REF = re.compile(r"(?i)^(?:vault[:/].*|env[:/].*|ref\+.*|secret(?:s|smanager)?[:/].*|ssm[:/].*|arn:.*|file:.*|keychain:.*|op://.*|sops:.*|kms:.*|gcp[-_]?secret.*|azure[-_]?keyvault.*|projects/.*/secrets/.*|os\.environ.*|os\.getenv.*|process\.env.*|getenv.*|env\..*|config\..*|settings\..*|self\..*|cfg\..*|conf\..*|this\..*|viper\..*|system\.getenv.*|import\.meta\.env.*|@.*@)$")
#: What vendors' credentials begin with, or hold after a short name of the vendor.
CAPITALS = ("AKIA", "ASIA", "AROA")
PREFIXES = ("gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk-", "sk_", "pk_live_", "rk_live_", "AIza", "npm_", "pypi-", "hf_", "SG.", "ya29.", "dop_v1_", "shpat_")
MIDDLES = ("_pat_", "_live_", "_prod_", "_test_", "_secret_", "_key_", "_tok_", "_sk_", "_api_")
_any = lambda words: "|".join(map(re.escape, words))
_VENDOR = re.compile(rf"^(?:{_any(CAPITALS)})[A-Z0-9]{{12,}}$|^(?:{_any(PREFIXES)})[A-Za-z0-9_\-.]{{6,}}$|^[a-z]{{2,6}}(?:{_any(MIDDLES)})[A-Za-z0-9]{{6,}}$")
_PARTIAL = re.compile(r"^(?:AKIA[A-Z0-9]{4,}|gh[pousr]_[A-Za-z0-9]{4,}|sk-[A-Za-z0-9]{4,}|eyJ[A-Za-z0-9+/_\-.]{6,})")

#: Names of SENSITIVE for the gate: "pat" and "pw" as a whole part of a name, long ones also with separators inside.
_SHORT = re.compile(r"p(?<![A-Za-z]p)(?:at|w)(?![a-z])|P(?<![A-Z]P)(?:(?:at|w)(?![a-z])|(?:AT|W)(?![A-Za-z]))")
_LONG = tuple(dict.fromkeys(w.replace("_", "") for w in SENSITIVE if len(w) > 4))
_PARTED = re.compile("|".join("[-._]*".join(w) for w in _LONG))


def split_name(name: str) -> list[str]:
    """Lower-case parts of an identifier."""
    return [p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if p]


@lru_cache(50_000)
def key_class(name: str) -> str:
    """sens, about (a setting about credentials), dig, url, user or other."""
    parts = split_name(name)
    if not parts:
        return "other"
    low = "_".join(parts)
    last, flat = parts[-1], "".join(parts)
    if last in DIGEST or any(low.endswith("_" + d) or low == d for d in DIGEST) or "public" in parts:
        return "dig"
    sens = any(low == s or low.endswith("_" + s) or flat.endswith(s) and len(s) > 4 for s in SENSITIVE)
    near = sens or any(s in parts or len(s) > 4 and s in flat for s in SENSITIVE)
    if near and (last in ABOUT or any(flat.endswith(a) for a in ABOUT if len(a) > 3)):
        return "about"
    if sens:
        return "sens"
    if near:
        return "near"
    if last in ("url", "uri", "dsn", "broker", "upstream", "endpoint", "host", "server", "connection"):
        return "url"
    if last in ("user", "username", "login", "account", "owner", "name"):
        return "user"
    return "key" if last == "key" else "other"


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


@lru_cache(50_000)
def shape(v: str) -> str:
    """What a value looks like."""
    v = v.strip()
    if _PLACE.match(v):
        return "place"
    if _REF.match(v):
        return "ref"
    if v.startswith("-----BEGIN"):
        return "pem"
    if v.startswith("data:"):
        return "data"
    if re.match(r"(?i)^sha\d+[-:]|^md5:", v):
        return "digest"
    if _VENDOR.match(v):
        return "vendor"
    if re.match(r"^eyJ[\w+/\-]+={0,2}\.[\w+/.\-=]+$", v):
        return "jwt"
    if _PARTIAL.match(v) and re.search(r"\d|[a-z][A-Z]", v[4:]):
        return "partial"
    if re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", v, re.I):
        return "uuid"
    if re.fullmatch(r"(?:0x)?[0-9a-f]{16,}", v, re.I) and re.search(r"\d", v):
        return "hex"
    if re.fullmatch(r"[-+]?[\d.,_]+[a-z%]{0,2}", v):
        return "num"
    if v.startswith(("/", "./", "../", "~/")) and not re.search(r"[=+]", v) or re.fullmatch(r"[\w.\-]+(?:/[\w.\-]+)+(?::\d+)?", v) and not re.search(r"[A-Z].*\d|\d.*[A-Z]", v):
        return "path"
    if "://" in v:
        return "link"
    if re.fullmatch(r"[\w\-]+\.(?:go|py|ts|js|json|ya?ml|md|txt|cpp|h|env|toml|example|com|org|net|io)", v):
        return "file"
    if re.fullmatch(r"[A-Za-z]+", v):
        if len(v) >= 16 and len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]", v)) >= 4 and _entropy(v) > 3.4:
            return "base64"
        turns = len(re.findall(r"[a-z][A-Z]", v))
        if len(v) >= 10 and turns >= 3 and turns >= 0.18 * len(v):  # no identifier turns that often
            return "base64"
        return "camel" if turns else "word"
    digits, upper, lower, other = (bool(re.search(p, v)) for p in (r"\d", r"[A-Z]", r"[a-z]", r"[^A-Za-z0-9]"))
    if re.fullmatch(r"[a-z]{3,}(?:[-.][a-z]{3,}){2,}\d*", v):
        return "phrase" if digits else "kebab"
    if re.fullmatch(r"[A-Za-z_]+", v):
        return "ident"
    if re.fullmatch(r"[a-z]+(?:-[a-z]+)+", v):
        return "kebab"
    if re.fullmatch(r"[A-Z][a-z]+\d+[^\sA-Za-z0-9]?[a-z]?", v):
        return "capnum"
    if re.fullmatch(r"[a-z0-9]+(?:_[a-z0-9]+)+", v) and re.search(r"[a-z]\d[a-z]", v):
        return "leet"
    if re.search(r"[()\[\]]", v) and re.match(r"[A-Za-z_.]+[(\[]", v):
        return "code"
    if re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)+", v) and not (digits and upper):
        return "dotted"
    if re.fullmatch(r"[A-Za-z0-9+/_\-]{12,}={0,3}", v) and digits + upper + lower >= 2 and _entropy(v) > 3.0:
        return "base64"
    if len(v) >= 7 and digits + upper + lower + other >= 3:
        return "mixed"
    if digits and (upper or lower):
        return "idnum"
    return "other"


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def lex(line: str) -> list[Token]:
    """Lexical tokens of one line; the value of an unquoted assignment is one token."""
    out: list[Token] = []
    i, n = 0, len(line)
    options = {m.start(f"f{m.lastgroup[1]}"): m for m in _OPTION.finditer(line)} if any(p in line for p in _PROGRAMS) else {}
    while i < n:
        if i in options:
            m, k = options[i], options[i].lastgroup[1]
            a, b = m.span(f"v{k}")
            out += [Token("key", "password", i, m.end(f"f{k}")), Token("op", "=", a, a), Token("val", line[a:b], a, b)]
            i = b
            continue
        if line[i].isspace():
            i += 1
            continue
        prev = out[-1] if out else None
        if prev and prev.kind == "op" and prev.text in ("=", ":", ":=") and len(out) > 1 and out[-2].kind in ("key", "word", "str", "q") and line[i] not in "\"'`([{<$%:":
            m = _URL.match(line, i) or line.startswith("-----BEGIN", i)
            if not m:  # unquoted value: up to a blank, quote or bracket
                m = _VALUE.match(line, i)
                if m and not re.match(r"[A-Za-z_][\w.]*[(\[]", line[i:]) and not re.match(r"[\w.\-]+(?::=|=)[^=]", m.group()) and "://" not in m.group():
                    text = _TRAIL.sub("", m.group())
                    pair = re.match(r"[\w.\-]+:(?=[^\s:/])", text)
                    if pair and out[-2].text.lower() in ("remove", "login", "credentials", "creds", "user"):  # user:password
                        k = pair.end() - 1
                        out += [Token("key", text[:k], i, i + k), Token("op", ":", i + k, i + k + 1), Token("val", text[k + 1 :], i + k + 1, i + len(text))]
                        i += len(text)
                        continue
                    if text:
                        out.append(Token("val", text, i, i + len(text)))
                        i += len(text)
                        continue
        m = _LEX.match(line, i)
        if not m:
            i += 1
            continue
        if m.lastgroup == "pass" or m.group("pass"):
            for g, kind in (("scheme", "scheme"), ("user", "user"), ("colon", "colon"), ("pass", "pass")):
                if m.group(g):
                    out.append(Token(kind, m.group(g), m.start(g), m.end(g)))
        else:
            kind, text = m.lastgroup, m.group()
            end = m.end()
            if kind == "str" and "://" in text and (u := _URL.search(line, i)) and u.start() < end:
                if u.start() > i:
                    out.append(Token("word", line[i : u.start()], i, u.start()))
                    i = u.start()
                    continue
                m = _LEX.match(line, i)
                for g, k in (("scheme", "scheme"), ("user", "user"), ("colon", "colon"), ("pass", "pass")):
                    if m.group(g):
                        out.append(Token(k, m.group(g), m.start(g), m.end(g)))
                i = m.end()
                continue
            if kind == "str" and "=" in text and "://" not in text and _PAIRS.fullmatch(text):
                by = ";" if ";" in text else "&"
                for part in text.split(by):
                    name, eq, value = part.partition("=")
                    if eq:
                        at = i + len(name)
                        out += [Token("key", name, i, at), Token("op", "=", at, at + 1)]
                        if value:
                            out.append(Token("val", value, at + 1, at + 1 + len(value)))
                    i += len(part) + 1
                i = end
                continue
            if kind == "str" and (kv := re.match(r"([A-Za-z_][\w.\-]*)([=:])(?=[^\s=])", text)) and "://" not in text and not _REF.match(text) and (key_class(kv.group(1)) != "other" or shape(text[kv.end() :]) in ("vendor", "jwt", "partial")):
                out += [Token("key", kv.group(1), i, i + kv.end(1)), Token("op", kv.group(2), i + kv.end(1), i + kv.end(2))]
                out.append(Token("val", text[kv.end() :], i + kv.end(), end))
                i = end
                continue
            if kind == "word":
                text = _TRAIL.sub("", text) or text
                end = i + len(text)
            out.append(Token(kind, text, i, end))
        i = m.end() if m.lastgroup != "word" else out[-1].end
    return out


#: Shapes that are no literal credential wherever they stand, and those that a bare word needs to be one.
_NEVER = ("num", "ref", "place", "digest", "data", "uuid", "link", "file", "code")
_LOUD = ("mixed", "capnum", "leet", "phrase", "base64", "hex", "jwt", "vendor", "partial", "pem", "idnum")
_CANDIDATE = ("str", "val", "pass", "word", "pem", "ref", "user")


def features(tokens: list[Token], line: str) -> list[list[str] | None]:
    """Features of each token; null for tokens that can't be a literal and always are "other"."""
    out: list[list[str] | None] = []
    key, kinds_before, words = "none", "", []
    best = "none"
    comment = line.lstrip().startswith(("#", "//", "*", "<!--", "--"))
    for i, t in enumerate(tokens):
        p1 = tokens[i - 1] if i else None
        p2 = tokens[i - 2] if i > 1 else None
        prev = p1.text.lower() if p1 else "^"
        if t.kind in ("key", "call") or (t.kind == "str" and i + 2 < len(tokens) and tokens[i + 1].kind == "q" and tokens[i + 2].text in (":", "]", "=", ",", "=>")):
            cls = key_class(t.text)
            if not (cls in ("other", "user") and t.text.lower() in ("value", "val", "default", "set", "conn.set", "setenv", "os.setenv")):
                key = cls
            if cls in ("sens", "about", "dig"):
                best = cls
            if t.kind != "str" or tokens[i + 2].text != ",":
                out.append(None)
                words.append(t.text.lower())
                continue
        if t.kind not in _CANDIDATE or (t.kind == "word" and len(t.text) < 3):
            out.append(None)
            if t.kind == "word":
                words.append(t.text.lower())
            continue
        s = shape(t.text.strip("!*&?") if t.kind == "word" else t.text)
        if s in _NEVER or t.kind == "word" and (s not in _LOUD or not t.text.isascii() or s == "mixed" and not re.search(r"\d", t.text)):
            if t.kind == "word" and s in ("word", "ident", "kebab", "camel"):
                cls = key_class(t.text)
                if cls != "other":
                    key = cls
                    if cls in ("sens", "about", "dig"):
                        best = cls
            out.append(None)
            words.append(t.text.lower())
            continue
        lead = next((w for w in reversed(words[-3:]) if w in ("bearer", "basic", "login", "password", "passphrase", "pass", "secret", "token", "credential", "credentials", "key", "remove")), "")
        quoted = p1 is not None and p1.kind == "q"
        gap = next((x.text.lower() for x in reversed(tokens[max(0, i - 2) : i]) if x.kind != "q"), "^")
        where = "pass" if t.kind == "pass" else "quoted" if quoted else t.kind
        about = "about" if best == "about" and key in ("sens", "about") else key
        f = ["bias", f"s={s}", f"k={about}", f"w={where}", f"s={s}|k={about}", f"s={s}|w={where}", f"s={s}|k={about}|w={where}", f"b={best}|s={s}", f"g={gap if len(gap) < 8 else 'x'}|s={s}", f"len={min(len(t.text) // 6, 6)}|s={s}"]
        if lead:
            f += [f"lead={lead}", f"lead={lead}|s={s}"]
        if comment:
            f.append(f"comment|s={s}")
        if p2 is not None and p2.kind == "word" and prev in ("/", ":"):
            f.append(f"pair|s={s}")
        out.append(f)
        words.append(t.text.lower())
    return out


LABELS = 2  # 0 other, 1 credential


class Chain:
    """Weights of a linear-chain CRF with two labels."""

    def __init__(self, weights: dict[str, float], transitions: list[list[float]]):
        self.w, self.t = weights, transitions

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Chain:
        d = json.loads(path.read_text())
        return cls(d["weights"], d["transitions"])

    def emissions(self, feats: list[list[str] | None]) -> list[float | None]:
        """Score of label 1 against 0; null where label 1 is impossible."""
        get = self.w.get
        return [None if f is None else sum(get(x, 0.0) for x in f) for f in feats]

    def viterbi(self, feats: list[list[str] | None]) -> list[int]:
        t = self.t
        e = self.emissions(feats)
        a0, a1, back = 0.0, -1e9, []
        for i, x in enumerate(e):
            if i == 0:
                a0, a1 = 0.0, (x if x is not None else -1e9)
                back.append((0, 0))
                continue
            f0, f1 = a0 + t[0][0], a1 + t[1][0]
            b0 = 0 if f0 >= f1 else 1
            n0 = max(f0, f1)
            if x is None:
                n1, b1 = -1e9, 0
            else:
                g0, g1 = a0 + t[0][1], a1 + t[1][1]
                b1 = 0 if g0 >= g1 else 1
                n1 = max(g0, g1) + x
            a0, a1 = n0, n1
            back.append((b0, b1))
        if not e:
            return []
        y = [0 if a0 >= a1 else 1]
        for b in reversed(back[1:]):
            y.append(b[y[-1]])
        return y[::-1]


@dataclass
class Span:
    line_no: int
    start: int
    end: int
    starts: bool  # false for the rest of a literal that began on an earlier line


_chain: Chain | None = None


def _get_chain() -> Chain:
    global _chain
    if _chain is None:
        _chain = Chain.load()
    return _chain


#: A line of a key's body: base64 (a padded end may be short), a header or a checksum, in a comment or a string or not.
_KEY_LINE = re.compile(r"[\s#/*\"'`+|>]*(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2}|=[A-Za-z0-9+/]{4}|(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID): ?[^\r\n\"'`]*)(?:\\[nr])*[\s\"'`,;+\\)]*")
_KEY_CUT = re.compile(r"[\s#/*\"'`+|>]*[A-Za-z0-9+/]+[\s\"'`]*")


def _key_run(text: str, starts: list[int], ends: list[int], n: int) -> int:
    """The last line of a key without an END that begins on line n; the text's last line may be cut anywhere."""
    last = j = n
    while j + 1 < len(starts):
        j += 1
        line = text[starts[j] : ends[j]]
        if _KEY_LINE.fullmatch(line) or j == len(starts) - 1 and last == j - 1 > n and _KEY_CUT.fullmatch(line):
            last = j
        elif line.strip(" \t#/*"):
            break
    return last


_ONLY_STRING = re.compile(r"\s*[\"'`][^\"'`]*[\"'`][)\],;.]*\s*\+?\\?\s*$")


def gate(text: str) -> list[int]:
    """Places that may make a credential of something on their line."""
    low = text.lower()
    if len(low) != len(text):  # a few letters are longer in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = [m.start() for m in _SHORT.finditer(text)]
    for where, words in ((low, NEEDLES), (text, CAPITALS + PREFIXES + MIDDLES + ("eyJ",))):
        for word in words:
            at = where.find(word)
            while at >= 0:
                hits.append(at)
                at = where.find(word, at + 1)
    squeezed = low.replace("_", "").replace("-", "").replace(".", "")
    if any(squeezed.count(w) > low.count(w) for w in _LONG):
        hits += [m.start() for m in _PARTED.finditer(low)]
    if any(p in low for p in _PROGRAMS):
        hits += [m.start(m.lastgroup) for m in _OPTION.finditer(text)]
    at = text.find("://")
    while at >= 0:
        end = m.start() if (m := LINE_END.search(text, at)) else len(text)
        if text.find("@", at, end) >= 0:
            hits.append(at)
        at = text.find("://", end)
    return hits


def find_spans(text: str, chain: Chain | None = None, gated: bool = True) -> list[Span]:
    """Character spans of the credentials of one text, with the number of the line (from 1) each is on."""
    hits = gate(text) if gated else [0, *(m.end() for m in LINE_END.finditer(text))]
    if not hits:
        return []
    chain = chain or _get_chain()
    starts, ends = [0], []
    for m in LINE_END.finditer(text):
        ends.append(m.start())
        starts.append(m.end())
    ends.append(len(text))
    todo = sorted({bisect.bisect_right(starts, h) - 1 for h in hits})
    out: list[Span] = []
    skip_to, extra = -1, -1
    k = 0
    while k < len(todo):
        n = todo[k]
        k += 1
        if n <= skip_to:
            continue
        line = text[starts[n] : ends[n]]
        pem = _PEM.search(line)
        if pem and not line[pem.end() :].lstrip().startswith("\\n") and "-----END" not in line[pem.end() :]:
            begin = starts[n] + pem.end()
            other = _PEM.search(text, begin)
            mark = _PEM_END.search(text, begin, other.start() if other else len(text))
            last = bisect.bisect_right(starts, mark.start()) - 1 if mark else _key_run(text, starts, ends, n)
            body = text[begin : mark.start() if mark else ends[last] if last > n else min(len(text), ends[n] + 4000)].split("-----END")[0]
            core = re.sub(r"[^A-Za-z0-9+/=]", "", body)
            if len(core) >= 24 and not re.search(r"\.\.\.|<|redacted|\*\*\*|xxxx", body, re.I):
                lead = " \t#/*" if "/" in line[: pem.start()] else " \t#*"  # a slash may belong to the key
                end_at = mark.end() if mark else ends[last]
                for j in range(n, last + 1):
                    a = starts[n] + pem.start() if j == n else starts[j] + len(text[starts[j] : ends[j]]) - len(text[starts[j] : ends[j]].lstrip(lead))
                    b = end_at if j == last else ends[j]
                    if b > a:
                        out.append(Span(j + 1, a, b, j == n))
            skip_to = last
            continue
        if extra == n:
            m = re.match(r"\s*[\"'`]([^\"'`]*)", line)
            out.append(Span(n + 1, starts[n] + m.start(1), starts[n] + m.end(1), False))
            found = [1]
        else:
            tokens = lex(line)
            labels = chain.viterbi(features(tokens, line))
            found = [i for i, y in enumerate(labels) if y]
            for i in found:
                joined = i - 1 in found and tokens[i].start == tokens[i - 1].end
                out.append(Span(n + 1, starts[n] + tokens[i].start, starts[n] + tokens[i].end, not joined))
        # A literal that goes on as a bare string on the next line.
        if found and n + 1 < len(starts) and (extra == n or (out and re.fullmatch(r"[\"'`]\s*\+?\\?\s*", text[out[-1].end : ends[n]]))):
            following = text[starts[n + 1] : ends[n + 1]]
            if _ONLY_STRING.fullmatch(following) and (extra == n or line.count("(") > line.count(")") or line.rstrip().endswith(("+", "\\"))):
                extra = n + 1
                if k >= len(todo) or todo[k] != n + 1:
                    todo.insert(k, n + 1)
    return out


SPANS = "array<struct<line_no:int,start:int,end:int,starts:boolean>>"


def find_credentials(df: DataFrame, content: str = "content") -> DataFrame:
    """All columns of ``df`` and line_no, span_start, span_end (characters), starts: one row per literal span.

    Lines count from 1 and end at \\r\\n, \\n or \\r. Null and empty contents have no rows; repeated rows are searched alike.
    """

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chain = _get_chain()
        for texts in batches:
            yield pd.Series([[s.__dict__ for s in find_spans(t, chain)] if isinstance(t, str) else [] for t in texts])

    names = {"line_no": "line_no", "span_start": "span_start", "span_end": "span_end", "starts": "starts"}
    clash = {c.lower() for c in df.columns} & set(names)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    return df.select("*", F.inline(spans.asNondeterministic()(F.col(content))).alias(*names))


def redact_text(text: str, spans: list[Span], mask: str = "REDACTED") -> str:
    """Exactly the spans' characters replaced; the rest of a literal on later lines becomes a mask of its own line."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s.start):
        if s.start < at:
            continue
        out += [text[at : s.start], mask]
        at = s.end
    return "".join(out) + text[at:]


def redact(df: DataFrame, content: str = "content", mask: str = "REDACTED") -> Column:
    """Column expression: the content with its credentials masked; null stays null."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chain = _get_chain()
        for texts in batches:
            yield texts.map(lambda t: redact_text(t, find_spans(t, chain), mask) if isinstance(t, str) else t)

    return masked(df[content])
