"""Trains the credential chain on generated lines: ``python -m siltstone.llm.train_credentials``.

Every line comes from a template with an invented value; the marks around it give the labels. No table of any data set is read.
"""

from __future__ import annotations

import base64
import json
import math
import random
import string

from siltstone.llm.credentials import WEIGHTS, Chain, features, lex

A, Z = "\x01", "\x02"
_SYLLABLES = ["ba", "cor", "den", "fi", "gal", "hex", "jun", "kel", "lom", "mar", "nim", "ol", "pra", "qui", "ros", "sel", "tam", "ur", "vex", "wil", "yon", "zet"]
_SENS = ["password", "passwd", "pwd", "pw", "passphrase", "secret", "client secret", "token", "access token", "api token", "auth token", "api key", "access key", "private key", "signing key", "deploy key", "secret key", "credential", "root password", "admin pw", "auth", "upstream auth", "license", "webhook secret", "encryption key", "db password"]
_ABOUT = ["password file", "token path", "api key header", "password min length", "secret rotation days", "token count", "key prefix", "password policy", "token ttl", "auth type", "secret name", "token url", "credential file", "pwd file", "passphrase hint", "token expiry", "key id", "auth mode", "password field", "token limit"]
_DIG = ["checksum", "sha256", "commit", "etag", "digest", "integrity", "fingerprint", "uuid", "trace", "image digest", "revision", "icon", "public key", "request id", "session ref", "build id", "content hash"]
_PLAIN = ["host", "name", "region", "mode", "label", "user", "bucket", "table", "path", "version", "cache", "queue", "index", "key", "prefix", "folder", "note", "image", "title", "window"]
_URLS = ["url", "dsn", "broker", "upstream", "database url", "redis url", "endpoint", "connection"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, n: int = 0) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(n or self.r.randint(2, 3)))

    def chars(self, alphabet: str, lo: int, hi: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(lo, hi)))

    def name(self, phrase: str, style: str | None = None) -> str:
        parts = phrase.split()
        if self.r.random() < 0.3:
            parts = [self.word(), *parts]
        style = style or self.r.choice(["snake", "camel", "upper", "kebab", "pascal"])
        if style == "camel":
            return parts[0] + "".join(p.title() for p in parts[1:])
        if style == "pascal":
            return "".join(p.title() for p in parts)
        return {"snake": "_", "upper": "_", "kebab": "-"}[style].join(parts).upper() if style == "upper" else {"snake": "_", "kebab": "-"}[style].join(parts)

    def credential(self, simple: bool = False) -> str:
        r = self.r
        alnum = string.ascii_letters + string.digits
        kinds = ["mixed", "phrase", "leet", "capnum", "alnum"] + ([] if simple else ["base64", "hex", "hex", "jwt", "vendor", "b64word", "own"])
        k = r.choice(kinds)
        if k == "mixed":
            return self.chars(string.ascii_letters, 2, 4) + self.chars(alnum + "!?%$&*+=~^_#", 5, 14) + r.choice("!?%$+=") + self.chars(string.digits, 1, 2)
        if k == "phrase":
            return "-".join(self.word() for _ in range(4)) + str(r.randint(1, 99))
        if k == "leet":
            w = self.word().translate(str.maketrans("aeios", "43105")) if r.random() < 0.8 else self.word()
            return f"{w}_{self.word()}{r.randint(10, 999)}"
        if k == "capnum":
            return self.word().title() + str(r.randint(100, 9999)) + r.choice(["", "!", "$", "+", "x", "#", "?"])
        if k == "alnum":
            return self.chars(string.ascii_letters, 1, 3) + self.chars(alnum, 7, 14) + self.chars(string.digits, 1, 1) + self.chars(string.ascii_letters, 1, 2)
        if k == "base64":
            return self.chars(alnum + "+/", 20, 43) + r.choice(["=", "", "=="])
        if k == "hex":
            size = r.choice([31, 39, 63])
            return self.chars("0123456789abcdef", size, size) + str(r.randint(0, 9))
        if k == "jwt":
            return "eyJ" + self.chars(alnum + "+/-_", 16, 36) + ".eyJ" + self.chars(alnum + "+/-_", 20, 60) + "." + self.chars(alnum + "-_", 24, 60)
        if k == "vendor":
            return r.choice([f"AKIA{self.chars(string.ascii_uppercase + string.digits, 16, 16)}", f"ghp_{self.chars(alnum, 36, 36)}", f"sk-{self.chars(alnum, 30, 48)}", f"xoxb-{self.chars(string.digits, 10, 12)}-{self.chars(alnum, 20, 24)}", f"glpat-{self.chars(alnum, 20, 20)}"])
        if k == "own":
            return f"{self.chars(string.ascii_lowercase, 3, 3)}_{r.choice(['pat', 'live', 'prod'])}_{self.chars(alnum, 20, 40)}"
        return base64.b64encode(self.credential(True).encode()).decode()

    def placeholder(self, name: str) -> str:
        u = name.upper().replace("-", "_")
        return self.r.choice(["", "changeme", "TODO", "your_key_here", "<your-token>", "<password>", "xxxxxxxx", "****", "********", "...", "example-token", "dummy", "${%s}" % u, "$(%s)" % u, "{{ vault_lookup }}", "%%%s%%" % u, f"env:{u}", f"vault:kv/{u}", f"ref+ssm://{u}", "redacted", "none", "null", "insert-here", f"${u}", "REPLACE_ME", "fake-secret"])

    def setting(self) -> str:
        return self.r.choice([str(self.r.randint(1, 2000)), f"/run/{self.word()}/{self.word()}", "x-api-key", self.word(), f"{self.word()}/{self.word()}", "true", f"{self.word()}.pem", f"{self.word()}_{self.word()}", f"{self.word()}-{self.word()}"])

    def digest(self) -> str:
        h = "0123456789abcdef"
        return self.r.choice([self.chars(h, 40, 40), self.chars(h, 64, 64), "sha256:" + self.chars(h, 40, 64), f"{self.chars(h, 8, 8)}-{self.chars(h, 4, 4)}-{self.chars(h, 4, 4)}-{self.chars(h, 4, 4)}-{self.chars(h, 12, 12)}", "sha512-" + self.chars(string.ascii_letters + string.digits + "+/", 80, 86) + "==", "data:image/png;base64," + self.chars(string.ascii_letters + string.digits + "+/", 60, 120)])

    def assignment(self, phrase: str, value: str) -> str:
        r = self.r
        n = lambda s=None: self.name(phrase, s)
        q = r.choice("\"'`")
        v = value
        return r.choice([
            lambda: f"{n('snake')} = {q}{v}{q}", lambda: f"{n('upper')} = {q}{v}{q}", lambda: f"const {n('camel')} = {q}{v}{q};", lambda: f"export const {n('upper')} = '{v}';",
            lambda: f"{n('camel')} := \"{v}\"", lambda: f"cfg.{n('camel')} = `{v}`", lambda: f"os.Setenv(\"{n('upper')}\", \"{v}\")", lambda: f"  {n('snake')}: {v}", lambda: f"  {n('camel')}: \"{v}\"  # rotate soon",
            lambda: f"- {{name: {n('upper')}, value: '{v}'}}", lambda: f"  \"{n('camel')}\": \"{v}\",", lambda: f"  \"env\": {{ \"{n('upper')}\": \"{v}\" }},", lambda: f"{n('upper')}={v}", lambda: f"export {n('upper')}='{v}'",
            lambda: f"client = connect({n('snake')}=\"{v}\")", lambda: f"headers[\"x-{n('kebab')}\"] = \"{v}\"", lambda: f"settings.{n('snake')}='{v}'", lambda: f"settings.{n('snake')}='{v}'", lambda: f"#define {n('upper')} \"{v}\"", lambda: f"static const char* k{n('pascal')} = \"{v}\";",
            lambda: f"conn.set(\"{n('snake')}\", \"{v}\");", lambda: f"process.env.{n('upper')} ??= `{v}`;", lambda: f"The {n('snake')} is {v} until further notice.", lambda: f"Use `{n('snake')}={v}` for the first login.",
            lambda: f"curl -d {n('snake')}={v} https://{self.word()}.example/v1", lambda: f"// {n('camel')} = \"{v}\"", lambda: f"# {n('snake')}: {v}", lambda: f"if {n('snake')} == \"{v}\":", lambda: f"    {n('camel')}: \"{v}\",", lambda: f"docker login -u {self.word()} --{n('kebab')}={v}",
            lambda: f"{n('upper')}=\"{v}\"",
        ])()

    def line(self) -> str:
        r = self.r
        mark = lambda v: A + v + Z
        x = r.random()
        if x < 0.26:
            return self.assignment(r.choice(_SENS), mark(self.credential()))
        if x < 0.36:
            p = r.choice(_SENS)
            return self.assignment(p, self.placeholder(p.replace(" ", "_")))
        if x < 0.45:
            return self.assignment(r.choice(_ABOUT), self.setting())
        if x < 0.53:
            return self.assignment(r.choice(_DIG), self.digest())
        if x < 0.59:
            return self.assignment(r.choice(_PLAIN), r.choice([self.setting(), self.setting(), self.digest(), self.word(), f"{self.word()} {self.word()}"]))
        if x < 0.62:
            return self.assignment(r.choice(_PLAIN), mark(r.choice([f"AKIA{self.chars(string.ascii_uppercase + string.digits, 16, 16)}", f"ghp_{self.chars(string.ascii_letters + string.digits, 36, 36)}", f"sk-{self.chars(string.ascii_letters + string.digits, 30, 48)}"])))
        if x < 0.74:
            scheme, host = r.choice(["postgres", "mysql", "redis", "amqp", "mongodb", "https"]), f"{self.word()}-{self.word()}.example"
            pw = mark(self.credential(True)) if r.random() < 0.55 else r.choice(["****", "<password>", "${PG_PASS}", "$(PASSWORD)", "{{ pw }}", "xxxx", "password"])
            tail = f"{r.choice([':' + str(r.randint(1, 9999)), ''])}/{self.word()}"
            return self.assignment(r.choice(_URLS), f"{scheme}://{r.choice([self.word(), self.word(), ''])}:{pw}@{host}{tail}")
        if x < 0.78:
            c = mark(self.credential())
            c = r.choice([f"Bearer {c}", f"Basic {mark(base64.b64encode((self.word() + ':' + self.credential(True)).encode()).decode())}", "Bearer ${TOKEN}", "Bearer <token>"])
            return r.choice([f"curl -H 'Authorization: {c}' https://{self.word()}.example/v2", f"# curl -H 'Authorization: {c}' https://{self.word()}.example/v2", f"// curl -H \"Authorization: {c}\" https://{self.word()}.example", f"headers = {{\"Authorization\": \"{c}\"}}", f"  \"curl\": \"-H 'Authorization: {c}'\","])
        if x < 0.82:
            a = self.credential()
            while len(a) < 18:
                a = self.credential()
            k = len(a) // 2
            p, q = self.name(r.choice(_SENS)), r.choice("\"'")
            a, b = mark(a[:k]), mark(a[k:])
            return r.choice([f"{p} = {q}{a}{q} + {q}{b}{q}", f"const {p} = [{q}{a}{q}, {q}{b}{q}].join(\"\");", f"{p} := \"{a}\" + \"{b}\"", f"{p} = ({q}{a}{q}", f"{p} = {q}{a}{q} {q}{b}{q}", f"{p} = {q}{a}{q} \\"])
        if x < 0.85:
            head = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"])
            body = "\\n".join(self.chars(string.ascii_letters + string.digits + "+/", 64, 64) for _ in range(3))
            return self.assignment(r.choice(["deploy key", "private key", "pem", "key"]), mark(f"-----BEGIN {head}-----\\n{body}\\n-----END {head}-----"))
        if x < 0.88:
            u, c, h = self.word(), mark(self.credential(True)), f"{self.word()}.example"
            return r.choice([f"# old login was {u} / {c}, still works on {h}", f"// TODO remove: {u}:{c}", f"TODO remove: {u}:{c}", f"log in as {u} with password {c}", f"# login: {u} password: {c}", f"// TODO remove: {u}", f"# old login was replaced on {h}"])
        w = self.word
        return r.choice([
            f"func {w()}Token{w().title()}({w()}Key *{w().title()}Token) {{", f"return {w()}_token({w()}[\"{w()}\"])", f"{w()}Token: string;", f"- name: {w()}_{w()}_token", f"image: {w()}/token:{r.randint(1, 999)}", f"for row in {w()}.embed_{w()}_token():", f"token: {r.randint(1, 999)}",
            f"password = os.environ[\"{w().upper()}\"]", "const apiKey = process.env.API_KEY;", f"password = os.getenv(\"{w().upper()}_PASSWORD\")", f"// {w()} hashes the default token of {w()}.", f"Our token check compares the {w()} from {w()} with the {w()} one.", "the password is read from the vault at start", f"log.info(\"{w()} inspects the token: %s\", {w()}Resolver)",
            f"args: [\"--token\", \"{w()}_{w()}\"]", "never put a token or secret here", f"\"{w()}_token\": {{ \"{w()}\": {r.randint(1, 999)}, \"{w()}\": true, \"path\": \"{w()}/{w()}\" }},", f"\"{w()}Key\": [\"{w()}_{w()}_token\", \"{w()}\", \"{w()}\"],", f"if err := auth.Check(token); err != nil {{", f"self.{w()}_token = {w()}Token or {{}}",
            f"\"{w().title()}Token\": \"{w()} {w()} of {w()}\",", f"export async function {w()}({w()}Key: {w().title()}Token[], limit = {r.randint(1, 999)}): Promise<{w().title()}> {{", f"if (!{w()}Token) throw new Error(\"{w()} row is {w()}\");", f"static const int {w()}TokenTable[] = {{{r.randint(1, 99)}, {r.randint(1, 999)}}};",
            f"def {w()}({w()}Token, {w()}_max={r.randint(1, 999)}):", f"The token of {w()}12 was {w()} in build {r.randint(1, 99)}b, see {w()}_{w()}.", f"Version v{r.randint(1, 9)}.{r.randint(1, 9)} of the {w()} key needs {w()}{r.randint(1, 9)} first.", f"Set the token to {r.randint(1, 999)} when the {w()} key of {w()} looks too small.", f"const {w()}KeyMap = new Map<string, {w().title()}Token>();", f"{w()}Token.{w()}{w().title()}(ctx, \"{w()}/{w()}\")", f"with close_{w()}(\"{w()}/token\") as {w()}Trace:", f"{w()}(\"{w()}\", {{ token: {r.randint(1, 999)}, pinned: true }});", f"prompt for the passphrase, do not store it", f"{w()}_{w()}_token: \"{w()}/{w()}\"", f"rotate_{w()}_token_mode={w()}", f"fetch_{w()}_key=/srv/{w()}/token", f"ulKeyMax > {r.randint(1, 99)}",
        ])


def sample(marked: str):
    spans, text, at = [], [], 0
    for c in marked:
        if c == A:
            spans.append([at, at])
        elif c == Z:
            spans[-1][1] = at
        else:
            text.append(c)
            at += 1
    line = "".join(text)
    tokens = lex(line)
    y = [int(any(a <= t.start and t.end <= b for a, b in spans)) for t in tokens]
    return line, tokens, y, spans


def train(n: int = 24_000, epochs: int = 4, seed: int = 3) -> Chain:
    maker = Maker(seed)
    data = []
    for _ in range(n):
        line, tokens, y, _ = sample(maker.line())
        f = features(tokens, line)
        if any(x is not None for x in f):
            data.append((f, [b if x is not None else 0 for b, x in zip(y, f)]))
    w: dict[str, float] = {}
    g: dict[str, float] = {}
    t, gt = [[0.0, 0.0], [0.0, 0.0]], [[1e-2] * 2, [1e-2] * 2]
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(data)
        for f, y in data:
            e = [None if x is None else sum(w.get(k, 0.0) for k in x) for x in f]
            m = len(e)
            # forward and backward sums in log space, label 1 impossible where e is null
            fw, bw = [[0.0, -1e9] for _ in e], [[0.0, 0.0] for _ in e]
            fw[0] = [0.0, e[0] if e[0] is not None else -1e9]
            lse = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
            for i in range(1, m):
                fw[i][0] = lse(fw[i - 1][0] + t[0][0], fw[i - 1][1] + t[1][0])
                fw[i][1] = lse(fw[i - 1][0] + t[0][1], fw[i - 1][1] + t[1][1]) + e[i] if e[i] is not None else -1e9
            for i in range(m - 2, -1, -1):
                one = e[i + 1] if e[i + 1] is not None else -1e9
                for a in (0, 1):
                    bw[i][a] = lse(t[a][0] + bw[i + 1][0], t[a][1] + one + bw[i + 1][1])
            z = lse(*fw[-1])
            for i in range(m):
                if f[i] is None:
                    continue
                d = math.exp(min(0.0, fw[i][1] + bw[i][1] - z)) - y[i]
                if abs(d) < 1e-4:
                    continue
                for k in f[i]:
                    g[k] = g.get(k, 1e-2) + d * d
                    w[k] = w.get(k, 0.0) - 0.25 * (d + 1e-3 * w.get(k, 0.0)) / math.sqrt(g[k])
            for i in range(1, m):
                for a in (0, 1):
                    for b in (0, 1):
                        if b and e[i] is None:
                            continue
                        p = math.exp(min(0.0, fw[i - 1][a] + t[a][b] + ((e[i] or 0.0) if b else 0.0) + bw[i][b] - z))
                        d = p - (y[i - 1] == a and y[i] == b)
                        if abs(d) > 1e-4:
                            gt[a][b] += d * d
                            t[a][b] -= 0.1 * d / math.sqrt(gt[a][b])
    return Chain({k: round(v, 3) for k, v in w.items() if abs(v) >= 0.02}, [[round(v, 4) for v in row] for row in t])


def held_out(chain: Chain, n: int = 4000, seed: int = 77) -> tuple[float, float]:
    """Precision and recall of whole lines on fresh generated ones."""
    maker, tp, fp, fn = Maker(seed), 0, 0, 0
    for _ in range(n):
        line, tokens, y, spans = sample(maker.line())
        got = any(chain.viterbi(features(tokens, line)))
        tp, fp, fn = tp + (got and bool(spans)), fp + (got and not spans), fn + (not got and bool(spans))
    return tp / max(1, tp + fp), tp / max(1, tp + fn)


if __name__ == "__main__":
    model = train()
    WEIGHTS.write_text(json.dumps({"transitions": model.t, "weights": dict(sorted(model.w.items()))}, indent=0))
    print("precision, recall on held-out lines:", held_out(model), len(model.w))
