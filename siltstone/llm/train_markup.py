"""Trains the markup tree on labelled pages made from snippets: ``python -m siltstone.llm.train_markup``.

A page joins plain sentences, sentences that only look like markup, and snippets of markup of every kind; what a snippet
contributes is labelled by where it came from. No table of any data set is read.
"""

from __future__ import annotations

import json
import random

import numpy as np

from siltstone.llm.markup import WEIGHTS, Piece, Tree, pieces

_W = ["anchor", "basket", "candle", "dragon", "ember", "forest", "garden", "harbor", "island", "jacket", "kettle", "lantern", "meadow", "needle", "orchard", "pebble", "quartz", "ribbon", "saddle", "timber", "umbrella", "valley", "window", "yonder", "zephyr"]


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def w(self) -> str:
        return self.r.choice(_W)

    def n(self) -> int:
        return self.r.randint(2, 1500)

    def plain(self) -> str:
        w, n = self.w, self.n
        return self.r.choice([
            f"The {w()} moved the {w()} to the {w()} after {n()} days.", f"Please keep {w()} below {n()}; the {w()} is fine.", f"- {w()} first\n- {w()} then\n3. {w()} last", f"1. Open the {w()}.\n2. Close the {w()}, then wait.", f"Version {n()} of {w()} renamed its {w()} (see {w()}).",
            f"Does {w()} know {w()}? Nobody does: it took {n()} seconds.", f"{w().title()}, {w()} and {w()} agree about {n()}.", f"当 {w()} 超过 {n()} 行时会停止。", f"Für {w()} gilt eine Grenze von {n()} Zeilen.", f"{w().title()} {w()}",
        ])

    def alike(self) -> str:
        w, n = self.w, self.n
        c = lambda: self.w() + self.w().title()
        return self.r.choice([
            f"The set {{{w()[0]}, b, c}} of {w()} is open.", f"The array is [{n()}, {n()}] and the call is {w()}_{w()}({c()}) since {w()}.", f"{w()}[0] = {c()}[{n()}] + 2 * 5 * {n()} in the window.", f"Map<String, {w().title()}> and List<int> hold {n()} items.", f"std::vector<{w().title()}> of {w()}",
            f"In {w()} the check {c()} < {n()} and {c()} > 2 holds.", f"The range is 1 <= {c()} <= {n()} and ~{n()} rows.", f"Read *.{w()} or *.{w()[:3]} files first, then ~/{w()}/{w()}.", f"A seat costs ${n()} and {w()} costs ${n()} a month.", f"${n()} {w()}", f"Set ${w().upper()}_HOME or %{w()}% before it starts.", f"Set ${w()}_{w()} and ${w()} first.",
            f"C:\\{w()}\\{w()}\\old and D:\\{w()}\\x are paths.", f"R&D keeps ticket #{n()} open, C# and C++ are old.", f"An arrow -> or => or <- between {w()} and {w()}.", f"The names {w()}_{w()}_{w()} and {w()}_{w()} are mixed up.", f"{w()}<{n()}", f"{w()} < {n()}", f"{w()} (*.{w()[:2]})", f"{w()} & {w()}", f"C# {w()}", f"F# and C#",
            f"a = b * c * d, x*y*z and 2*3*4", f"rate = {n()}% ~ {n()}", f"email {w()}@{w()}.example or #{w()}", f"{w()}::{w()}::{w()}()", f"if (a < b && c > d) return x[i][j];", f"use --{w()}={n()} or -{w()[0]}", f"__{w()}__ as __init__.py", f"{w()}*, {w()}*", f"** {w()}", f"{w()} ~ {w()} ~ {w()}", f"regex ^\\d+\\s*$ and \\w+", f"x -- y --- z", f"{w()} = {w()}", f"a | b | c", f"tr '{w()}' \"{w()}\"", f"it's {w()}'s and {w()}s' turn", f"fn(x)[1](y)", f"{{{w()}: {n()}}}", f"Optional<T> of {w()}", f"<{n()} MB and >{n()} MB", f"Dict[str, List[int]] and Tuple[{w()}, ...]", f"{w()}/*.{w()[:3]} and **/*.{w()[:3]}", f"# {n()} of {n()}" if self.r.random() < 0.1 else f"No #{n()}",
        ])

    def marked(self, heading: bool = False) -> str:
        w, n, r = self.w, self.n, self.r
        short = [
            f"**{w()}** {w()}", f"~~{w()}~~ {w()}", f"`{w()}_{w()}` {w()}", f"[{w()} {w()}](#{w()})", f"[[{w()}]]", f"== {w()} ==", f"## {w()}", f"\\textit{{{w()}}} {w()}", f"{w()} $O(n^{r.randint(2, 9)})$", f"<span>{w()}</span> {w()}", f"<a name=\"{w()}\"></a>{w()}", f"{w()} &amp; {w()}", f"{w()} {{#{w()}-{w()}}}", f"''{w()}'' {w()}", f"*{w()}* {w()}", f"_{w()}_ {w()}", f"<b>{w()}</b>", f"{w()} <sup>{n()}</sup>", f"\\section{{{w()}}}", f"# {w()} {w()}", f"'''{w()}'''", f"{w()}<br/>{w()}", f"\\emph{{{w()}}}", f"$x_{{{n()}}}$ {w()}", f"{w()} &mdash; {w()}", f"`{w()}` {w()}", f"![{w()}]({w()}.png)", f"=== {w()} ===", f"{{{{{w()}|{w()}}}}}", f"[{w()}](https://{w()}.example/{n()})", f"### {w()} ###",
        ]
        if heading:
            return r.choice(short)
        t = "`" * 3
        long = [
            f"The **{w()} {w()}** must not reach *{w()}* first.", f"The _{w()}_ of {w()} is ***never*** read.", f"Call `{w()}_{w()}()` first, then `{w()}` from {w()}.", f"See [the {w()}](../{w()}/{w()}.md) for {n()}.", f"![{w()} of {w()}](img/{w()}-{n()}.png)", f"~~The {w()}~~ is gone, use __{w()}__ now.", f"The {w()} is explained below.[^{r.randint(1, 9)}]", f"[^{r.randint(1, 9)}]: By the {w()} crew.", f"The [{w()} {w()}][ref] accepts it.", f"[ref]: https://{w()}.example/{n()}", f"### {w()} and the {w()}\nIt accepts.", f"#### {w()} ####\nThe {w()} skips.", f"{w()} {w()}\n==========\nThe {w()} rests.", f"{w()} {w()}\n----------\nThe {w()} rests.", f"{t}go\n{w()} := {w()}({n()})\n{t}", f"~~~\n{w()} --limit {n()}\n~~~", f"> The {w()} embeds.\n> Ask {w()}.", f"- [ ] check the {w()}\n- [x] drop the {w()}", f"* * *\nThe {w()} copies.", f"---\n{w()}", f"| {w()} | {w()} |\n|---|---:|\n| {w()} | {n()} |\n| {w()} | {n()} |", f"Ask at <https://{w()}.example/{w()}> for it.", f"{w()} {{#{w()}-{w()}}}",
            f"<p>{w()} shows the {w()}.</p><br/>It takes {n()} seconds.", f"Open <a href=\"/{w()}/{w()}\">the {w()}</a> and look.", f"<h{r.randint(1, 6)}>{w()}</h2>\n<pre><code>{w()}({w()}, {n()})</code></pre>", f"<ul><li>{w()} of {w()}</li><li>{w()}</li></ul>", f"<table><tr><th>{w()}</th><td>{n()}</td></tr></table>", f"<div class=\"{w()}\">\nThe {w()} sits.\n</div>", f"The <font color=red>{w()}</font> {w()}, H<sub>2</sub>, m<sup>{n()}</sup>.", f"The <b>{w()}</b> of {w()} is <em>{w()}</em>.", f"<IMG SRC='{w()}.gif' ALT=\"{w()}\"> shows {w()}.", f"<!-- todo {w()} {n()} -->The {w()} skips.", f"<details><summary>{w()}</summary>The {w()} rests.</details>", f"The {w()}<BR>of {w()}<BR/>caches.", f"{w()} needs {w()} &amp; {w()} &mdash; {n()}&nbsp;MB.", f"It&#8217;s the {w()} that &lt;{w()}&gt; compares.", f"<code>{w()}</code> and <i>{w()}</i>", f"<blockquote>{w()}</blockquote>",
            f"== {w()} {w()} ==\nThe {w()} counts.", f"__TOC__\n=== {w()} ===\nThe {w()} stores.", f"'''{w()}''' is a ''{w()}'' with {n()} rows.", f"The [[{w()}|{w()} of {w()}]] forwards a [[{w()} {w()}]].", f"[[Category:{w()}]]\nThe {w()} groups.", f"{{{{Infobox|name={w()}|size={n()}}}}}\n{w()} rejects it.", f"See [https://{w()}.example/{w()} the {w()} page] and {{{{cite|{w()}|{n()}}}}}.", f"{{| class=\"wikitable\"\n! {w()} !! {w()}\n|-\n| {w()} || {n()}\n|}}", f"It came from {w()}<ref>{w()} list, entry {n()}</ref> in step {n()}.", f":: The <nowiki>{w()}</nowiki> drops ''{w()}''.", f"#REDIRECT [[{w()} {w()}]]", f":* {w()}" if False else f": {w()} ''{w()}''",
            f"\\section{{{w()}}}\nThe {w()} records.", f"\\subsection*{{{w()} of {w()}}}\n\\label{{sec:{w()}}}\nThe {w()} rejects.", f"The \\textbf{{{w()}}} of \\emph{{{w()}}} grows.", f"Let \\(x < {n()}\\) be the \\texttt{{{w()}}}.", f"Its score is $s_{{{n()}}} = \\frac{{{n()}}}{{n + 1}}$ for {w()}.", f"$$\\alpha \\leq {n()} \\cdot \\beta$$ bounds {w()}.", f"\\[ w = \\sum_{{i=1}}^{{{n()}}} x_i \\cdot y_i \\]\nThis is {w()}.", f"\\begin{{equation}}\nr_{n()} = \\sqrt{{{n()}}}\n\\end{{equation}}\nholds.", f"\\begin{{itemize}}\n\\item {w()} of {w()}\n\\item {w()}\n\\end{{itemize}}", f"\\begin{{tabular}}{{ll}}\n{w()} & {n()} \\\\\n{w()} & {w()}\n\\end{{tabular}}", f"\\begin{{verbatim}}\n{w()} {n()}\n\\end{{verbatim}}\nis printed.", f"The {w()}\\footnote{{Only in {w()}.}} grows by {n()}\\,\\% a week.", f"As shown in~\\ref{{fig:{w()}}} and \\cite{{{w()}{n()}}}, it skips.", f"Take $n$ and $k = {n()}$ here.", f"100\\% of \\{w()}{{{w()}}}" if False else f"{n()}\\% of {w()}\\_{w()}",
        ]
        return r.choice(long if r.random() < 0.8 else short)

    def page(self) -> tuple[str, list[tuple[int, int]]]:
        """Text and the spans of its marked snippets."""
        rich = self.r.random()
        parts, marks, at = [], [], 0
        heading = self.r.random() < 0.25
        for _ in range(1 if heading else self.r.randint(1, 6)):
            x = self.r.random()
            kind = "marked" if x < (0.5 if rich < 0.5 else 0.1) else "alike" if x < 0.7 else "plain"
            if heading:
                kind = self.r.choice(["marked", "alike", "alike", "plain"])
            s = self.marked(heading) if kind == "marked" else getattr(self, kind)()
            if kind == "marked":
                marks.append((at, at + len(s)))
            parts.append(s)
            gap = "\n\n" if kind == "marked" or self.r.random() < 0.7 else " "
            if gap == " " and "\n" in s:
                gap = "\n\n"
            parts.append(gap)
            at += len(s) + len(gap)
        return "".join(parts), marks


def labels(found: list[Piece], marks: list[tuple[int, int]]) -> list[int]:
    """A piece is markup where it lies in a marked snippet; "angle" and "compare" never are of themselves."""
    return [int(any(a <= p.start and p.end <= b for a, b in marks) and p.kind not in ("compare", "angle")) for p in found]


def train(n: int = 9000, epochs: int = 5, seed: int = 11) -> Tree:
    pages, data = Pages(seed), []
    for _ in range(n):
        text, marks = pages.page()
        found, blocks = pieces(text)
        if found:
            data.append((found, blocks, labels(found, marks)))
    tree = Tree({}, {k: [[0.0, 0.0], [0.0, 0.0]] for k in Tree.EDGES})
    g: dict[str, float] = {}
    ge = {k: np.full((2, 2), 1e-2) for k in Tree.EDGES}
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(data)
        for found, blocks, y in data:
            parent, edge, unary, first = tree.graph(found, blocks)
            prob, pair = tree.marginals(parent, edge, unary)
            state = [0] * first + y
            for i in range(len(parent) - 1, 0, -1):  # a block is marked where a piece in it is, the page where a block is
                if i >= first or parent[i] == 0:
                    state[parent[i]] = max(state[parent[i]], state[i]) if parent[i] < first else state[parent[i]]
            feats = [["page"]] + [["block"]] * (first - 1) + [p.feats for p in found]
            for fs, p, s in zip(feats, prob, state):
                d = float(p) - s
                if abs(d) < 1e-3:
                    continue
                for f in fs:
                    g[f] = g.get(f, 1e-2) + d * d
                    tree.w[f] = tree.w.get(f, 0.0) - 0.3 * (d + 1e-3 * tree.w.get(f, 0.0)) / g[f] ** 0.5
            for i in range(1, len(parent)):
                d = pair[i].copy()
                d[state[parent[i]], state[i]] -= 1
                ge[edge[i]] += d * d
                tree.e[edge[i]] = (np.array(tree.e[edge[i]]) - 0.1 * (d + 1e-3 * np.array(tree.e[edge[i]])) / np.sqrt(ge[edge[i]])).tolist()
    tree.w = {k: round(v, 3) for k, v in tree.w.items() if abs(v) >= 0.01}
    tree.e = {k: [[round(x, 4) for x in row] for row in v] for k, v in tree.e.items()}
    return tree


def held_out(tree: Tree, n: int = 2000, seed: int = 99) -> tuple[float, float]:
    """Precision and recall over fresh pages: does a page hold markup."""
    pages, tp, fp, fn = Pages(seed), 0, 0, 0
    for _ in range(n):
        text, marks = pages.page()
        found, blocks = pieces(text)
        got = bool(found) and bool((tree.probabilities(found, blocks) > 0.5).any())
        tp, fp, fn = tp + (got and bool(marks)), fp + (got and not marks), fn + (not got and bool(marks))
    return tp / max(1, tp + fp), tp / max(1, tp + fn)


if __name__ == "__main__":
    model = train()
    WEIGHTS.write_text(json.dumps({"edges": model.e, "weights": dict(sorted(model.w.items()))}, indent=0))
    print("precision, recall on held-out pages:", held_out(model), len(model.w))
