"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from curalens.llm.common import blocks, one_array, prepare, text_of

#: Elements that flow inside a block; every other element begins and ends one.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr "
                   "acronym "
                   "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover "
                   "mmultiscripts mprescripts mtable semantics annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style noscript template svg iframe object canvas".split())
#: Inline marks that part words.
PARTING = frozenset("br hr img input mspace mtr mlabeledtr mtd".split())
#: An open element of the left kind ends where one of the right kind begins beside it.
ENDED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: A ">" inside a quoted value doesn't end a tag; a quote that never closes is no quote.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A value without quotes takes a slash at its end.
OPEN_VALUE = re.compile(r"""=\s*[^\s"'>][^\s"'>]*$""")
NAMES = re.compile(r"[A-Za-z]+")
NEAR, FAR = 6, 4                      # ancestors of a block that count: the nearest and the outermost
PATHS, WORDS, NUMBERS = 512, 1024, 6  # hashed path parts, hashed words, numeric inputs
P_DIM, W_DIM, HIDDEN = 16, 8, 16
SPAN = 4096                           # blocks of a page whose gate inputs exist at a time
LEARNED = 512                         # blocks in a training sequence; a longer page gives several


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]
    linked: int                        # characters inside links


def parse_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, in one pass over its tags.

    Broken markup gives some result for every input: an end tag without a start is skipped, an
    element left open ends with the one around it, an unclosed comment or script runs to the end.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_count: dict[str, int] = {}
    held: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text and not any(map(open_count.get, RAW)):
            names = [s[1] for s in stack]
            out.append(Block(text, tuple(names if len(names) <= NEAR + FAR else names[:FAR] + names[-NEAR:]), linked))
        held.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            held.append(text)
            if links:
                linked += len(text.strip())

    def close(tag: str) -> None:
        while stack:
            name, _ = stack.pop()
            open_count[name] -= 1
            if name == tag:
                return

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            say(page[at:])
            break
        say(page[at:mark])
        if page.startswith("<!--", mark):
            if page.startswith((">", "->"), mark + 4):        # an empty comment
                at = page.index(">", mark) + 1
            else:
                end = COMMENT_END.search(page, mark + 4)
                at = end.end() if end else size
            continue
        if page[mark + 1:mark + 2] in ("!", "?"):
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        found = TAG.match(page, mark)
        if not found:
            say("<")
            at = mark + 1
            continue
        closing, tag, attributes, at = found[1], found[2].lower(), found[3], found.end()
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at) if tag in ("script", "style") else None
                if tag in ("script", "style"):
                    at = size if end is None else page.find(">", end.start()) + 1 or size
                elif not attributes.endswith("/") or OPEN_VALUE.search(attributes):
                    flush()
                    stack.append((tag, (tag,)))
                    open_count[tag] = open_count.get(tag, 0) + 1
            elif open_count.get(tag):
                held.clear()
                close(tag)
            continue
        if tag in PARTING:
            held.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in INLINE:
            links = max(0, links + (-1 if closing else 1)) if tag == "a" else links
            continue
        flush()
        links = 0
        if closing:
            if open_count.get(tag):
                close(tag)
            continue
        while stack and (by := ENDED_BY.get(stack[-1][0], ())) != () and (by is None or tag in by):
            open_count[stack.pop()[0]] -= 1
        parts = [tag]
        for quoted, single, bare in ATTRIBUTE.findall(attributes):
            parts += [f".{n.lower()}" for n in NAMES.findall(quoted or single or bare)[:6]]
        stack.append((tag, tuple(parts)))
        open_count[tag] = open_count.get(tag, 0) + 1
    flush()
    return out


def _bucket(text: str, n: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % n


class Features:
    """Inputs of a list of pages: hashed path parts and words with their blocks, and numbers."""

    def __init__(self, pages: list[list[Block]]):
        self.lengths = np.array([len(p) for p in pages], np.int64)
        path_ids, path_rows, word_ids, word_rows, numbers = [], [], [], [], []
        row = 0
        for page in pages:
            for at, block in enumerate(page):
                parts = {p for group in block.path for p in group} | {f"1{p}" for group in block.path[-1:] for p in group}
                path_ids += [_bucket(p, PATHS) for p in parts]
                path_rows += [row] * len(parts)
                words = block.text.split(" ")
                word_ids += [zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS for w in words]
                word_rows += [row] * len(words)
                n = len(block.text)
                numbers.append((np.log1p(n) / 5, np.log1p(len(words)) / 4, min(1.0, block.linked / max(1, n)), at / max(1, len(page) - 1),
                                float(block.text[-1] in ".!?…。"), min(len(block.path), 10) / 10))
                row += 1
        self.n = row
        self.path_ids, self.path_rows = np.array(path_ids, np.int64), np.array(path_rows, np.int64)
        self.word_ids, self.word_rows = np.array(word_ids, np.int64), np.array(word_rows, np.int64)
        self.word_n = np.maximum(1, np.bincount(self.word_rows, minlength=row)).astype(float) if row else np.ones(0)
        self.numbers = np.array(numbers, float).reshape(row, NUMBERS)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])


def _sum_rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row; rows rise."""
    out = np.zeros((n, values.shape[1]))
    if len(rows):
        seen, first = np.unique(rows, return_index=True)
        out[seen] = np.add.reduceat(values, first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Two LSTM passes over the blocks of a page, forward and back, and a logistic output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        width = P_DIM + W_DIM + NUMBERS

        def small(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.weights = {"path": rng.normal(0, 0.1, (PATHS, P_DIM)), "word": rng.normal(0, 0.1, (WORDS, W_DIM)), "out": small(2 * HIDDEN + width, 1), "bias": np.zeros(1)}
        for way in ("f", "b"):
            self.weights |= {f"x{way}": small(width, 4 * HIDDEN), f"h{way}": small(HIDDEN, 4 * HIDDEN), f"c{way}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}

    def inputs(self, f: Features) -> np.ndarray:
        w = self.weights
        return np.concatenate([_sum_rows(w["path"][f.path_ids], f.path_rows, f.n), _sum_rows(w["word"][f.word_ids], f.word_rows, f.n) / f.word_n[:, None], f.numbers], axis=1)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """States (page, block, HIDDEN) and what the way back needs."""
        w, (pages, steps, _) = self.weights, x.shape
        h = c = np.zeros((pages, HIDDEN))
        states, tape = np.zeros((pages, steps, HIDDEN)), []
        ahead = x @ w[f"x{way}"] + w[f"c{way}"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = ahead[:, t] + h @ w[f"h{way}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            tape.append((t, i, f, o, g, c, h, tc, m))
            h, c = new_h, new_c
            states[:, t] = h
        return states, tape

    def _padded(self, f: Features, rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps = int(f.lengths[rows].max())
        at = f.starts[rows][:, None] + np.arange(steps)
        mask = (np.arange(steps) < f.lengths[rows][:, None]).astype(float)
        return x[np.minimum(at, len(x) - 1)] * mask[:, :, None], mask, at

    def _states(self, x: np.ndarray, mask: np.ndarray, way: str) -> np.ndarray:
        """States (page, block, HIDDEN), a span of blocks at a time with the state carried from span to span."""
        w, (pages, steps, _) = self.weights, x.shape
        h = c = np.zeros((pages, HIDDEN))
        out = np.empty((pages, steps, HIDDEN))
        spans = range(0, steps, SPAN)
        for a in spans if way == "f" else reversed(spans):
            ahead = x[:, a:a + SPAN] @ w[f"x{way}"] + w[f"c{way}"]
            for t in range(ahead.shape[1]) if way == "f" else range(ahead.shape[1] - 1, -1, -1):
                z = ahead[:, t] + h @ w[f"h{way}"]
                gates = _sigmoid(z[:, :3 * HIDDEN])
                m = mask[:, a + t, None]
                c = m * (gates[:, HIDDEN:2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN:])) + (1 - m) * c
                h = m * (gates[:, 2 * HIDDEN:] * np.tanh(c)) + (1 - m) * h
                out[:, a + t] = h
        return out

    def probabilities(self, f: Features, cells: int = 1 << 14) -> np.ndarray:
        """Of every block. Pages of like lengths run together, as many as fill at most ``cells`` blocks with
        their padding; a longer page runs alone."""
        out = np.zeros(f.n)
        if not f.n:
            return out
        x = self.inputs(f)
        order = np.argsort(f.lengths, kind="stable")
        order = order[f.lengths[order] > 0]
        first = 0
        while first < len(order):
            fits = f.lengths[order[first:first + cells]] * np.arange(1, min(cells, len(order) - first) + 1) <= cells
            rows = order[first:first + max(1, int(fits.sum()))]          # both factors rise, so those that fit come first
            first += len(rows)
            padded, mask, at = self._padded(f, rows, x)
            states = np.concatenate([self._states(padded, mask, "f"), self._states(padded, mask, "b"), padded], axis=2)
            score = _sigmoid(states @ self.weights["out"] + self.weights["bias"])[:, :, 0]
            out[at[mask > 0]] = score[mask > 0]
        return out

    def _gradients(self, f: Features, labels: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        w, x = self.weights, self.inputs(f)
        padded, mask, at = self._padded(f, rows, x)
        runs = {way: self._run(padded, mask, way) for way in ("f", "b")}
        states = np.concatenate([runs["f"][0], runs["b"][0], padded], axis=2)
        error = (_sigmoid(states @ w["out"] + w["bias"])[:, :, 0] - labels[np.minimum(at, f.n - 1)]) * mask / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["out"] = (states * error[:, :, None]).sum((0, 1))[:, None]
        grads["bias"] = np.array([error.sum()])
        back = error[:, :, None] * w["out"][:, 0]
        d_x = back[:, :, 2 * HIDDEN:].copy()
        for k, way in enumerate(("f", "b")):
            d_states = back[:, :, k * HIDDEN:(k + 1) * HIDDEN]
            dh = dc = np.zeros((len(rows), HIDDEN))
            for t, i, fg, o, g, c, h, tc, m in reversed(runs[way][1]):
                dh = dh + d_states[:, t]
                d_new_c = dc + m * dh * o * (1 - tc * tc)
                dz = m * np.concatenate([d_new_c * g * i * (1 - i), d_new_c * c * fg * (1 - fg), dh * tc * o * (1 - o), d_new_c * i * (1 - g * g)], axis=1)
                grads[f"x{way}"] += padded[:, t].T @ dz
                grads[f"h{way}"] += h.T @ dz
                grads[f"c{way}"] += dz.sum(0)
                d_x[:, t] += dz @ w[f"x{way}"].T
                dh = (1 - m) * dh + dz @ w[f"h{way}"].T
                dc = (1 - m) * dc + m * d_new_c * fg
        flat = np.zeros((f.n, x.shape[1]))
        flat[at[mask > 0]] = d_x[mask > 0]
        np.add.at(grads["path"], f.path_ids, flat[f.path_rows, :P_DIM])
        np.add.at(grads["word"], f.word_ids, flat[f.word_rows, P_DIM:P_DIM + W_DIM] / f.word_n[f.word_rows, None])
        return grads

    def fit(self, pages: list[list[Block]], labels: list[list[int]], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the mean cross-entropy of the blocks."""
        rng = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        step = 0
        kept = [k for k, p in enumerate(pages) if p]
        for _ in range(epochs):
            order = rng.permutation(kept)
            for first in range(0, len(order), batch):
                chosen = order[first:first + batch]
                f = Features([pages[k] for k in chosen])
                y = np.array([v for k in chosen for v in labels[k]], float)
                step += 1
                for k, g in self._gradients(f, y, np.arange(len(chosen))).items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.weights[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)


#: Names under which pages keep what isn't the article; they mark training blocks only.
SIDE_TAGS = frozenset("nav header footer aside form head title menu dialog button select option textarea label legend fieldset".split())
SIDE_NAMES = ("ad ads advert advertisement sponsored promo banner sidebar widget menu navigation navbar breadcrumb breadcrumbs header footer masthead cookie "
              "consent notice alert popup modal newsletter subscribe signup login search share social related recommended comment comments reply replies "
              "disqus respond pagination pager tags copyright legal").split()
BODY_NAMES = "content post entry article story main body text page single blog news".split()
FRAMES = ('<div class="{n}">{i}</div>', '<div id="{n}">{i}</div>', '<section class="{n}">{i}</section>', '<aside>{i}</aside>', '<aside class="{n}">{i}</aside>',
          '<form class="{n}"><label>{x}</label>{i}<button>{x}</button></form>', '<nav>{i}</nav>', '<header>{i}</header>', '<footer>{i}</footer>',
          '<section id="{n}"><h2>{x}</h2><div class="{n}-item"><b>{x}</b>{i}</div></section>', '<ul class="{n}"><li>{x}</li><li><a href="#">{x}</a></li></ul>')
INSIDE = ("{x}", "<p>{x}</p>", "<h3>{x}</h3><p>{x}</p>", '<ul><li><a href="#">{x}</a></li><li>{x}</li></ul>', '<a href="#">{x}</a> <a href="#">{x}</a>',
          "<div>{x}</div>", "<p>{x}</p><p>{x}</p><p>{x}</p>")
ARTICLE = re.compile(r"<(/?)article\b[^>]*>", re.I)


def is_main(block: Block) -> int:
    """Training label: inside an article, main or body-text element, and in none that pages keep for other things."""
    parts = {p for group in block.path for p in group}
    if parts & SIDE_TAGS or any(f".{n}" in parts for n in SIDE_NAMES):
        return 0
    return int(bool(parts & {"article", "main"}) or any(f".{n}" in parts for n in BODY_NAMES))


def variants(page: str, rng: random.Random) -> list[str]:
    """The page, and two with other frames: the article under another element, side blocks of its own words put around and into it."""
    words = re.sub(r"<[^>]*>|&\w+;", " ", page).split() or ["text"]

    def side() -> str:
        at = rng.randrange(len(words))
        frame = rng.choice(FRAMES).replace("{i}", rng.choice(INSIDE))
        return frame.format(n=rng.choice(SIDE_NAMES), x=entities.escape(" ".join(words[at:at + rng.randint(1, 25)])) + rng.choice(["", "."]))

    out = [page]
    for _ in range(2):
        name, tag = rng.choice(BODY_NAMES), rng.choice(["div", "section", "main", "article"])
        changed = ARTICLE.sub(lambda m: f"</{tag}>" if m[1] else f'<{tag} class="{name}">', page)
        # Marks go where a paragraph ends or begins, so they stand beside, before or after blocks of the article.
        gaps = [m.start() for m in re.finditer(r"<p>|<h1>|</body>|<footer>|<article|<div|<section|<main", changed)]
        for gap in sorted(rng.sample(gaps, min(len(gaps), rng.randint(1, 4))), reverse=True):
            changed = changed[:gap] + side() + changed[gap:]
        out.append(changed)
    return out


def train(pages: DataFrame, html_col: str = "html", sample: int = 300, epochs: int = 8) -> BlockLabeller:
    """Fit on at most ``sample`` different pages, those with the least hashes, and variants of them.

    The hashes are ordered first and the html of the chosen pages is fetched after, so no task and not the driver
    holds more pages than these.
    """
    hashed = pages.select(text_of(html_col).alias("html")).withColumn("hash", F.xxhash64("html"))
    least = hashed.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    rows = hashed.where(F.col("hash") <= least).groupBy("hash").agg(F.min("html").alias("html")).orderBy("hash").collect() if least is not None else []
    rng = random.Random(11)
    parsed = [page[a:a + LEARNED] for r in rows for v in variants(r.html, rng) for page in [parse_blocks(v)] for a in range(0, len(page), LEARNED)]
    model = BlockLabeller()
    model.fit(parsed, [[is_main(b) for b in p] for p in parsed], epochs)
    return model


def main_texts(model: BlockLabeller, pages: list[str], at: float = 0.5) -> list[str]:
    parsed = [parse_blocks(p) for p in pages]
    chosen = (model.probabilities(Features(parsed)) >= at).tolist()
    out, first = [], 0
    for page in parsed:
        out.append(" ".join(b.text for b, c in zip(page, chosen[first:first + len(page)]) if c))
        first += len(page)
    return out


def page_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", **training) -> DataFrame:
    """Main text of every whole page: blocks the labeller takes for the article, in page order.

    Null or empty html gives an empty text. Rows repeat as in the input, whatever their ids; an
    empty table gives no rows; other columns are ignored. Long pages are read whole and labelled in one sequence;
    only for training are they cut.
    """
    spark = prepare(pages.sparkSession)
    model = spark.sparkContext.broadcast(train(pages, html_col, **training))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = main_texts(model.value, block.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([one_array(block.column("page_id")), one_array(block.column("url")), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
            .mapInArrow(extract, "page_id long, url string, text string, n_chars long"))


#: What the labeller should find on pages whose article stands in one article element.
ARTICLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)</article>', 1, 's') AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(body, '<[^>]*>', ' ', 'g') AS plain FROM a),
d AS (SELECT page_id, url, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(plain, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
             '&quot;?', '"', 'g'), '&#39;', chr(39)), '&amp;?', '&', 'g') AS plain FROM t),
x AS (SELECT page_id, url, trim(regexp_replace(plain, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM x
"""
