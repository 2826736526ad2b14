"""Main text of web pages by boosted trees over page nodes and hierarchical decoding.

A node is positive when main text lies in or under it.  The trees give each node
its own chance; taken alone these can contradict each other.  Decoding takes the
most likely labelling in which a positive node's ancestors are positive, found
exactly by one pass from the leaves up and one down.

The trees are trained here, on pages made by a rule from a seed: layouts with
and without telling tags and class names, whose main part is known.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscope.llm.boosting import Boosted, fit
from dealscope.llm.shared import given_id, held_id
from dealscope.llm.html_tree import TOKENS, Node, features, parse, text_of

_MAIN = "@@"  # marks main text in training pages


def decode(nodes: list[Node], odds: list[float]) -> list[bool]:
    """The likeliest labels in which every ancestor of a positive node is positive."""
    n = len(nodes)
    # the gain of labelling a node and what is under it best, over labelling all of it negative
    gain = list(odds)
    for k in range(n - 1, 0, -1):
        if gain[k] > 0:
            gain[nodes[k].parent.at] += gain[k]
    keep = [False] * n
    keep[0] = gain[0] > 0
    for k in range(1, n):
        keep[k] = keep[nodes[k].parent.at] and gain[k] > 0
    return keep


def main_text(page: str | None, model: Boosted) -> str:
    return main_texts([page], model)[0]


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [parse(p or "") for p in pages]
    rows = [r for t in trees for r in features(t)]
    odds = model.log_odds(np.array(rows)).tolist()
    out, at = [], 0
    for t in trees:
        out.append(text_of(t, decode(t, odds[at : at + len(t)])))
        at += len(t)
    return out


@lru_cache(maxsize=4)
def trained(pages: int = 1600, seed: int = 5) -> Boosted:
    """The model, fitted on ``pages`` made pages."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        nodes = parse(_page(rng))
        for v in reversed(nodes):
            own = any(isinstance(p, str) and _MAIN in p for p in v.parts)
            v.y = int(own or any(c.y for c in v.kids))
        x += features(nodes)
        y += [v.y for v in nodes]
    return fit(np.array(x), np.array(y, float), trees=60)


def _words(rng: random.Random, n: int, mark: str = "") -> str:
    out = []
    for k in range(n):
        w = "".join(rng.choice("aeiouéäolnrstdhbm") for _ in range(rng.randint(1, 9)))
        out.append(w.capitalize() if k == 0 else w)
        if rng.random() < 0.1:
            out[-1] += rng.choice(".,,%&#")
    return mark + " ".join(out) + rng.choice([".", ".", "", "!"])


def _attr(rng: random.Random, *groups: str) -> str:
    if rng.random() < 0.5:
        return ""
    w = rng.choice(TOKENS[rng.choice(groups)].split())
    w = rng.choice([w, f"{w}-{rng.choice(['box', 'wrap', 'area', 'block', '1'])}", f"site-{w}", f"{w} wide"])
    return f' {rng.choice(["class", "class", "id"])}="{w}"'


def _links(rng: random.Random, most: int) -> str:
    items = [f'<a href="/x">{_words(rng, rng.randint(1, 3))}</a>' for _ in range(rng.randint(2, most))]
    return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)


def _other(rng: random.Random) -> str:
    kind = rng.choice(["menu", "head", "foot", "side", "advert", "notice", "comment", "form", "share"])
    attr = _attr(rng, kind)
    if kind == "menu":
        tag = rng.choice(["nav", "nav", "div"])
        return f"<{tag}{attr or (' class=\"menu\"' if tag == 'div' else '')}>{_links(rng, 9)}</{tag}>"
    if kind == "head":
        tag = rng.choice(["header", "header", "div"])
        title = rng.choice(["h1", "h2", "div", "p"])
        return f"<{tag}{attr or (' class=\"header\"' if tag == 'div' else '')}><{title}>{_words(rng, rng.randint(1, 5))}</{title}>{_links(rng, 4) if rng.random() < 0.5 else ''}</{tag}>"
    if kind == "foot":
        tag = rng.choice(["footer", "footer", "div"])
        inner = f"&copy; {_words(rng, rng.randint(2, 25))}"
        return f"<{tag}{attr or (' class=\"footer\"' if tag == 'div' else '')}>{inner if rng.random() < 0.6 else f'<p>{inner}</p>'}{_links(rng, 4) if rng.random() < 0.3 else ''}</{tag}>"
    if kind == "side":
        tag = rng.choice(["aside", "aside", "div"])
        return f"<{tag}{attr or (' class=\"sidebar\"' if tag == 'div' else '')}><h3>{_words(rng, 2)}</h3>{_links(rng, 6) if rng.random() < 0.6 else ''}<p>{_words(rng, rng.randint(3, 40))}</p></{tag}>"
    if kind == "comment":
        tag = rng.choice(["div", "section"])
        posts = "".join(f"<{t}><b>{_words(rng, 1)}</b><p>{_words(rng, rng.randint(2, 50))}</p></{t}>" for t in [rng.choice(["div", "li", "article", 'div class="comment"'])] * rng.randint(1, 5))
        posts = posts.replace('</div class="comment">', "</div>")
        name = rng.choice(["comments", "comment-list", "discussion", "replies", "reader-comments"])
        return f'<{tag} {rng.choice(["class", "id"])}="{name}"><h3>{_words(rng, 2)}</h3>{posts}</{tag}>'
    if kind == "form":
        return f"<form{attr}><label>{_words(rng, 2)}</label><input name=q><p>{_words(rng, rng.randint(2, 15))}</p><button>{_words(rng, 1)}</button></form>"
    inner = _words(rng, rng.randint(2, 30))
    body = rng.choice([inner, f"<p>{inner}</p>", f'<p>{inner}</p><a href="/x">{_words(rng, 2)}</a>'])
    tag = rng.choice(["div", "div", "section", "aside", "p"])
    return f"<{tag}{attr or f' class=\"{rng.choice(TOKENS[kind].split())}\"'}>{inner if tag == 'p' else body}</{tag}>"


def _plain_other(rng: random.Random) -> str:
    """A part beside the main text that no tag or name tells: links with a heading, short lines, a copyright line."""
    kind = rng.random()
    head = rng.choice(["", f"<h3>{_words(rng, rng.randint(1, 3))}</h3>", f"<h4>{_words(rng, rng.randint(1, 2))}</h4>", f"<p><b>{_words(rng, rng.randint(1, 2))}</b></p>", f"<b>{_words(rng, 1)}</b>"])
    if kind < 0.5:
        body = head + _links(rng, 12)
    elif kind < 0.65:
        body = head + "".join(f'<p><a href="/y">{_words(rng, rng.randint(1, 6))}</a></p>' for _ in range(rng.randint(1, 6)))
    elif kind < 0.75:
        body = head + "".join(f'<div><a href="/z"><img src=i.png></a><a href="/z">{_words(rng, rng.randint(2, 8))}</a></div>' for _ in range(rng.randint(2, 6)))
    elif kind < 0.9:
        body = f"&copy; {_words(rng, rng.randint(1, 6))}" + (f' | <a href="/t">{_words(rng, 1)}</a>' if rng.random() < 0.6 else "")
    else:
        body = f"<form action=/s><input name=q><button>{_words(rng, 1)}</button></form>"
    return rng.choice([f"<div>{body}</div>", f"<div>{body}</div>", f"<section>{body}</section>", body if body.startswith("<ul>") else f"<div>{body}</div>"])


def _broken(rng: random.Random, page: str) -> str:
    """The page as careless authors write it: ends of elements left out, capitals, unquoted values."""
    for end in ("</p>", "</li>", "</td>", "</tr>"):
        if rng.random() < 0.5:
            page = page.replace(end, "")
    if rng.random() < 0.3:
        page = page.replace("<p>", rng.choice(["<P>", "<p align=left>", "<p data-a=it's>", "<p style='x: y'>"]))
    return page


def _page(rng: random.Random) -> str:
    """A made page; pieces of main text begin with the mark."""
    plain = rng.random() < 0.35  # no part is told by a tag or a name
    main = [f"<h{rng.choice([1, 1, 1, 2])}>{_words(rng, rng.randint(2, 12), _MAIN)}</h1>"] if rng.random() < 0.8 else []
    sizes = [6, 10, 30, 60, 120] if plain else [1, 2, 3, 6, 10, 30, 60, 120]
    for _ in range(rng.choice([2, 2, 3, 5, 8] if plain else [1, 1, 1, 2, 3, 5, 8, 14])):
        n = rng.choice(sizes)
        kind = rng.random()
        if kind < 0.75:
            open_b = "<b>" if rng.random() < 0.15 else ""
            close = "</p>" if rng.random() < 0.85 else "<br>"
            main.append(f"<p>{open_b}{_words(rng, n, _MAIN)}{close}")
        elif kind < 0.83:
            main.append(f"<h{rng.randint(2, 4)}>{_words(rng, rng.randint(1, 8), _MAIN)}")
            main[-1] += f"</{main[-1][1:3]}>"
        elif kind < 0.9:
            main.append("<ul>" + "".join(f"<li>{_words(rng, rng.randint(1, 15), _MAIN)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.95:
            main.append(f"<blockquote>{_words(rng, n, _MAIN)}</blockquote>")
        else:
            main.append(f"<table><tr><td>{_words(rng, 3, _MAIN)}</td><td>{_words(rng, 2, _MAIN)}</td></tr></table>")
        if not plain and rng.random() < 0.07:
            main.append(_other(rng))
    body = "".join(main)
    if plain and rng.random() < 0.15:
        body = f"<div>{'<br><br>'.join(_words(rng, rng.choice([20, 40, 80]), _MAIN) for _ in range(rng.randint(2, 5)))}</div>"
    if plain:
        body = _plain_page(rng, body)
    else:
        wrap = rng.choice(["article", "article", "article", "main", "div", "section"])
        body = f"<{wrap}{_attr(rng, 'content') or (' class=\"content\"' if wrap == 'div' and rng.random() < 0.7 else '')}>{body}</{wrap}>"
        if rng.random() < 0.12:
            side = "".join(_other(rng) for _ in range(rng.randint(1, 3)))
            cells = [f"<td>{side}</td>", f"<td>{body}</td>"]
            body = f"<table><tr>{''.join(cells if rng.random() < 0.6 else cells[::-1])}</tr></table>"
        before = "".join(_other(rng) for _ in range(rng.randint(0, 4)))
        after = "".join(_other(rng) for _ in range(rng.randint(0, 4)))
        body = before + body + after
        if rng.random() < 0.3:
            body = f'<div{rng.choice(["", " id=page", " class=wrapper", " class=container"])}>{body}</div>'
    page = f"<html><head><title>{_words(rng, 4)}</title><style>p{{}}</style></head><body>{body}</body></html>"
    return _broken(rng, page) if rng.random() < 0.2 else page


def _plain_page(rng: random.Random, main: str) -> str:
    """Main text between parts that only their contents tell: a table of columns, bare divisions, or one flow."""
    before = "".join(_plain_other(rng) for _ in range(rng.randint(0, 3)))
    after = "".join(_plain_other(rng) for _ in range(rng.randint(0, 3)))
    side = "".join(_plain_other(rng) for _ in range(rng.randint(1, 2)))
    kind = rng.random()
    if kind < 0.35:
        cells = [f"<td>{side}</td>", f"<td>{main}</td>"]
        rows = f"<tr>{''.join(cells if rng.random() < 0.6 else cells[::-1])}</tr>"
        if rng.random() < 0.4:
            rows = f"<tr><td colspan=2>{_plain_other(rng)}</td></tr>" + rows
        return f"{before}<table>{rows}</table>{after}"
    if kind < 0.75:
        columns = [f"<div>{side}</div>", f"<div>{main}</div>"]
        return f"{before}<div>{''.join(columns if rng.random() < 0.5 else columns[::-1])}</div>{after}"
    return f"{before}<div>{main}</div>{after}" if rng.random() < 0.6 else before + main + after


def extract_main(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), model: Boosted | None = None) -> DataFrame:
    """One row a page: id, the ``keep`` columns, text, n_chars.

    Text is the decoded main text, blocks joined by two newlines; empty where a
    page is null or has none.  Whole pages are read, of any length.  Repeated rows
    give repeated results; null ids stay; other columns are ignored; an empty table
    gives no rows.
    """
    model = model or trained()
    source = pages.select(held_id(pages, id_col).alias("id"), *[held_id(pages, c).alias(f"k{k}") for k, c in enumerate(keep)], F.col(html_col).alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "html")
    others = [c for c in source.columns if c != "html"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                part = pdf[a : a + 200]
                texts = main_texts(part["html"].tolist(), model)
                yield part[others].assign(text=texts, n_chars=[len(t) for t in texts])

    out = source.mapInPandas(run, f"{kinds}, text string, n_chars long")
    return out.select(given_id(out).alias(id_col), *[given_id(out, f"k{k}").alias(c) for k, c in enumerate(keep)], "text", "n_chars")
