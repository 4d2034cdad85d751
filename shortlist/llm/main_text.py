"""Main text of pages by a tree-structured graphical model over their elements (operator 7)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shortlist.llm.common import texts_of
from shortlist.llm.labelled_pages import labelled_pages
from shortlist.llm.page_tree import Page, names_of, parse

#: Labelled pages that the model is fitted on.
TRAINING_PAGES = 600
#: Elements that hold other blocks; text elements have their own parent-child potentials.
HOLDERS = frozenset("#page html body div section article main aside nav header footer form table tbody tr td ul ol dl center "
                    "figure fieldset dialog".split())
EXTRACTED = "page_id long, url string, text string, n_chars long"


@dataclass
class Forest:
    """The nodes of several pages, and the order in which messages pass."""

    parents: np.ndarray
    kinds: np.ndarray
    levels: list[np.ndarray]


def kinds_of(page: Page) -> list[int]:
    """0: plain text element, 1: holder, 2: text element right below the body, 3: text element with a name."""
    top = ("#page", "html", "body")
    return [1 if t in HOLDERS else 2 if page.tags[p] in top else 3 if m and names_of(m)[0] else 0
            for t, p, m in zip(page.tags, page.parents, page.marks, strict=True)]


def votes_of(forest: Forest) -> np.ndarray:
    """Weight of each node's own potential: plain text elements below one parent share one vote, however many they are."""
    plain = (forest.kinds == 0) | (forest.kinds == 2)
    groups = np.where(plain, forest.parents, -1)
    number = np.bincount(groups[plain], minlength=len(groups)) if plain.any() else np.zeros(len(groups), np.int64)
    return np.where(plain, 1 / np.maximum(number[groups], 1), 1.0)


def forest_of(pages: list[Page]) -> Forest:
    starts = np.concatenate([[0], np.cumsum([len(p.tags) for p in pages])])
    parents = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + s) for p, s in zip(pages, starts, strict=False)])
    depths = np.concatenate([np.array(p.depths) for p in pages])
    kinds = np.concatenate([np.array(kinds_of(p), np.int64) for p in pages])
    order = np.argsort(depths, kind="stable")
    bounds = np.searchsorted(depths[order], np.arange(depths.max() + 2))
    return Forest(parents, kinds, [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(forest: Forest, own: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on trees. own: log-potential of each node's two labels; pairs: by kind of child, parent and child label.

    Messages pass upward level by level, then downward. Returns each node's marginal of label 1 and the marginals of each
    node with its parent (parent label, own label).
    """
    belief, up = own.copy(), np.zeros_like(own)
    for level in reversed(forest.levels[1:]):
        up[level] = log_sum(belief[level][:, None, :] + pairs[forest.kinds[level]], 2)
        np.add.at(belief, forest.parents[level], up[level])
    both = np.zeros((len(own), 2, 2))
    for level in forest.levels[1:]:
        outside = belief[forest.parents[level]] - up[level]
        joint = outside[:, :, None] + pairs[forest.kinds[level]] + belief[level][:, None, :]
        belief[level] = log_sum(joint, 1)
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        both[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), both


def bins(pages: list[Page]) -> np.ndarray:
    """For each node its class of own text length, and that of the share of linked text below it."""
    out = []
    for p in pages:
        n = len(p.tags)
        own, all_chars, linked = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text, link in p.blocks:
            own[node] += len(text)
            linked[node] += link
        all_chars[:] = own
        for i in range(n - 1, 0, -1):
            all_chars[p.parents[i]] += all_chars[i]
            linked[p.parents[i]] += linked[i]
        length = np.digitize(own, [1, 15, 40, 100, 300])
        share = np.where(all_chars > 0, np.digitize(linked / np.maximum(all_chars, 1), [0.01, 0.3, 0.7]), 4)
        out.append(length * 5 + share)
    return np.concatenate(out)


def node_features(tag: str, attributes: str) -> list[str]:
    names = sorted(set(names_of(attributes)[0]))
    return [f"tag {tag}", *[f"name {w}" for w in names]] if names else [f"tag {tag}", f"plain {tag}"]


@dataclass
class TreeModel:
    """Log-odds of main text by feature and by text class, and the parent-child potentials."""

    weights: dict[str, float]
    classes: np.ndarray
    pairs: np.ndarray

    def own(self, pages: list[Page], forest: Forest, seen: dict[tuple[str, str], float]) -> np.ndarray:
        odds = np.empty(sum(len(p.tags) for p in pages))
        k = 0
        for p in pages:
            for key in zip(p.tags, p.marks, strict=True):
                value = seen.get(key)
                if value is None:
                    if len(seen) > 100_000:
                        seen.clear()
                    value = seen[key] = sum(self.weights.get(f, 0.0) for f in node_features(*key))
                odds[k] = value
                k += 1
        odds = (odds + self.classes[bins(pages)]) * votes_of(forest)
        return np.stack([np.zeros_like(odds), odds], axis=1)


def labels_of(page: Page) -> np.ndarray:
    """Marks (y=0, y=1) handed down the tree."""
    y = np.zeros(len(page.tags))
    y[0] = len(y) == 1
    for i in range(1, len(y)):
        mark = names_of(page.marks[i])[1].get("y")
        y[i] = y[page.parents[i]] if mark is None else float(mark)
    return y


def train(pages: list[str], steps: int = 200, rate: float = 0.15, decay: float = 5e-5) -> TreeModel:
    """Maximum likelihood of the labelled trees by gradient ascent (Adam); expectations come from `marginals`."""
    trees = [parse(p) for p in pages]
    forest, y = forest_of(trees), np.concatenate([labels_of(t) for t in trees])
    features: dict[str, int] = {}
    rows, columns = [], []
    k = 0
    for t in trees:
        for tag, mark in zip(t.tags, t.marks, strict=True):
            for f in node_features(tag, mark):
                rows.append(k)
                columns.append(features.setdefault(f, len(features)))
            k += 1
    rows, columns, text, votes = np.array(rows), np.array(columns), bins(trees), votes_of(forest)
    inner = forest.parents >= 0
    size = len(features)
    theta = np.zeros(size + 30 + 16)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((4, 2, 2))
    np.add.at(seen, (forest.kinds[inner], y[forest.parents[inner]].astype(int), y[inner].astype(int)), 1)
    for step in range(1, steps + 1):
        odds = (np.bincount(rows, theta[columns], len(y)) + theta[size + text]) * votes
        pairs = theta[size + 30:].reshape(4, 2, 2)
        p, both = marginals(forest, np.stack([np.zeros_like(odds), odds], axis=1), pairs)
        gap = (y - p) * votes
        expected = np.zeros((4, 2, 2))
        np.add.at(expected, forest.kinds[inner], both[inner])
        slope = np.concatenate([np.bincount(columns, gap[rows], size), np.bincount(text, gap, 30), (seen - expected).ravel()]) / len(y)
        slope -= decay * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
        theta += rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return TreeModel({f: float(theta[i]) for f, i in features.items()}, theta[size:size + 30], theta[size + 30:].reshape(4, 2, 2))


def extract(model: TreeModel, texts: list[str], seen: dict) -> list[str]:
    """The main text of some pages: blocks of elements whose marginal is a half or more."""
    pages = [parse(t) for t in texts]
    if not pages:
        return []
    forest = forest_of(pages)
    main, _ = marginals(forest, model.own(pages, forest, seen), model.pairs)
    out, start = [], 0
    for p in pages:
        out.append("\n\n".join(text for node, text, _ in p.blocks if main[start + node] >= 0.5))
        start += len(p.tags)
    return out


def main_text(pages: DataFrame, model: TreeModel | None = None, id_column: str = "page_id", url_column: str = "url",
              html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html.

    Elements are nodes; tag, names, text length and share of links give each node's potential, parent and child label
    theirs; marginals come from messages up and down the tree. The model is trained on TRAINING_PAGES labelled pages
    unless one is given. Null, empty and text-less html give the empty text; null ids, null urls and repeated rows keep
    their rows; other columns are ignored; an empty table gives no rows. Scripts, styles and their like are never text.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages(TRAINING_PAGES)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, {}
        for batch in batches:
            texts = texts_of(batch.column(2))
            for at in range(0, batch.num_rows, 100):
                found = extract(model, texts.slice(at, 100).to_pylist(), seen)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 100), batch.column(1).slice(at, 100), pa.array(found, pa.string()),
                     pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"),
                        pages[html_column].cast("string").alias("html")).mapInArrow(run, EXTRACTED)
