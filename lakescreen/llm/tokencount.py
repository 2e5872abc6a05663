"""Token counts that follow edits: a segment tree of pre-token counts for each document.

Leaves are stretches of pre-tokens between cuts at which byte-pair encoding never joins: before white space that follows
something else. Each leaf has its token count, each inner node its children's sums. Edits are applied by regions: the
leaves that neighbouring edits touch, and a leaf of boundary context where a region's end is no safe cut any more. A
region's new text is cut into leaves again, encoded, and joined into the tree, which keeps its balance; sums change only
on the way to the root.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread
from .tokenbin import VOCABULARY, Tokenizer, vocabulary
from .wordarray import byte_slices

#: Pieces of text in a leaf.
LEAF = 16
#: Blanks that follow something else: a run of white space is always read from its beginning, so a cut there is safe.
CUT = re.compile(r"(?<=\S)(?=[ \t\n])")
#: How many times as many leaves one side of a node may hold.
LEAN = 3


class Node:
    """A leaf with its text, or an inner node; both with their sums."""

    __slots__ = ("chars", "count", "leaves", "left", "right", "text")

    def __init__(self, left: Node | None, right: Node | None, text: str = "", count: int = 0):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.leaves, self.count, self.chars = 1, count, len(text)
        else:
            self.leaves, self.count, self.chars = left.leaves + right.leaves, left.count + right.count, left.chars + right.chars


def balanced(leaves: list[Node]) -> Node | None:
    while len(leaves) > 1:
        pairs = [Node(a, b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0] if leaves else None


def join(a: Node | None, b: Node | None) -> Node | None:
    """The leaves of a and then of b. Only nodes along one side of the larger tree are made anew."""
    if a is None or b is None:
        return a or b
    if a.leaves > LEAN * b.leaves:
        return _right_heavy(a.left, join(a.right, b))
    if b.leaves > LEAN * a.leaves:
        return _left_heavy(join(a, b.left), b.right)
    return Node(a, b)


def _right_heavy(a: Node, b: Node) -> Node:
    if b.leaves <= LEAN * a.leaves:
        return Node(a, b)
    if b.left.leaves < 2 * b.right.leaves:
        return Node(Node(a, b.left), b.right)
    return Node(Node(a, b.left.left), Node(b.left.right, b.right))


def _left_heavy(a: Node, b: Node) -> Node:
    if a.leaves <= LEAN * b.leaves:
        return Node(a, b)
    if a.right.leaves < 2 * a.left.leaves:
        return Node(a.left, Node(a.right, b))
    return Node(Node(a.left, a.right.left), Node(a.right.right, b))


def cut(node: Node | None, k: int) -> tuple[Node | None, Node | None]:
    """The first k leaves and the others."""
    if node is None or k <= 0:
        return None, node
    if k >= node.leaves:
        return node, None
    if k <= node.left.leaves:
        a, b = cut(node.left, k)
        return a, join(b, node.right)
    a, b = cut(node.right, k - node.left.leaves)
    return join(node.left, a), b


def leaves_of(text: str) -> list[str]:
    pieces = CUT.split(text) if text else []
    return ["".join(pieces[k : k + LEAF]) for k in range(0, len(pieces), LEAF)]


class Tree:
    """The pre-tokens of a text, with its token count kept up to date under edits."""

    def __init__(self, tokenizer: Tokenizer, leaves: list[str], counts: list[int]):
        self.tokenizer = tokenizer
        self.root = balanced([Node(None, None, t, n) for t, n in zip(leaves, counts, strict=True)])
        self.encoded = 0  # characters encoded again by edits

    @staticmethod
    def of(tokenizer: Tokenizer, text: str) -> Tree:
        leaves = leaves_of(text)
        return Tree(tokenizer, leaves, list(map(tokenizer.count, leaves)))

    def total(self) -> int:
        return self.root.count if self.root else 0

    def text(self) -> str:
        return "".join(self.leaf(k) for k in range(self.root.leaves)) if self.root else ""

    def leaf(self, k: int) -> str:
        node = self.root
        while node.left is not None:
            node, k = (node.left, k) if k < node.left.leaves else (node.right, k - node.left.leaves)
        return node.text

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character; the end of the text belongs to the last leaf."""
        node, k, begin = self.root, 0, 0
        while node.left is not None:
            left = node.left
            if char - begin < left.chars:
                node = left
            else:
                node, k, begin = node.right, k + left.leaves, begin + left.chars
        return k, begin

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace characters [start, end) by a new text, for edits in the order of their places, none over another."""
        at = moved = 0
        while at < len(edits):
            at, moved = self._region(edits, at, moved)

    def _region(self, edits: list[tuple[int, int, str]], at: int, moved: int) -> tuple[int, int]:
        """Apply the edits from number ``at`` that fall into one region; the next edit, and how far the text has moved.

        A region goes on while edits touch its end, or while what it ends with would not encode apart from the next leaf.
        """
        size = self.root.leaves if self.root else 0
        first, begin = self.leaf_at(edits[at][0] + moved) if size else (0, 0)
        if first > 0 and edits[at][0] + moved == begin:  # the cut before this leaf is touched
            first, begin = first - 1, begin - len(self.leaf(first - 1))
        last, here, said = first, begin, self.leaf(first) if size else ""
        done, out = begin, []
        while True:
            end = here + len(said)
            while at < len(edits) and edits[at][0] + moved <= end:
                a, b, new = edits[at][0] + moved, edits[at][1] + moved, edits[at][2]
                out += filter(None, (said[done - here : a - here], new))
                while b > end:
                    last, here = last + 1, end
                    said = self.leaf(last)
                    end += len(said)
                done, at = b, at + 1
            out += filter(None, (said[done - here :],))
            done = end
            if last + 1 >= size or out and not out[-1][-1].isspace():
                break
            last, here = last + 1, end
            said = self.leaf(last)
        changed = "".join(out)
        self.encoded += len(changed)
        left, rest = cut(self.root, first)
        self.root = join(join(left, Tree.of(self.tokenizer, changed).root), cut(rest, last + 1 - first)[1])
        return at, moved + len(changed) - (done - begin)


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in edits:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


#: What the production query edits: runs of blanks become one space, digits of six or more become one mark.
MASKED = re.compile(r"[ \t]{2,}|(?<![0-9])[0-9]{6,}|(?<=@)[A-Za-z0-9.-]+")


def mask_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), " " if m[0][0] in " \t" else "#" if m[0].isdigit() else "host") for m in MASKED.finditer(text)]


def counts(docs: DataFrame, edits: Callable[[str], list] = mask_edits, path: str = VOCABULARY) -> DataFrame:
    """One row (doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_encoded) for each row of ``docs``.

    n_tokens: of the whole text; n_tokens_edited: after the edits, from the tree; n_chars_encoded: characters that the
    edits had encoded again, at most a constant times the leaves that edits touch and what they write, however dense they
    are. Null and empty texts have no tokens and no edits. Repeated rows count alike, and ties cannot occur. A text of any
    length is one row's work: its tree holds one node for about 100 characters. An empty table gives no rows. Columns other
    than doc_id and text are not looked at, so further ones may have any name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(held.value)
        for batch in batches:
            rows = []
            for some in byte_slices(batch.column("text")):
                texts = [t or "" for t in some.to_pylist()]
                leaves = list(map(leaves_of, texts))
                counts = iter(tokenizer.encode_all(pa.array(chain.from_iterable(leaves), pa.string()))[1].tolist())
                for text, mine in zip(texts, leaves, strict=True):
                    tree, found = Tree(tokenizer, mine, list(islice(counts, len(mine)))), edits(text)
                    before = tree.total()
                    tree.apply(found)
                    rows.append((before, len(found), tree.total(), tree.encoded))
            if rows:
                told = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *told], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded"])

    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_encoded long")
