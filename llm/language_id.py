"""Language identification by cross-parsing.

For every language a suffix automaton of labelled text is built. A text is parsed into phrases, each the longest that
occurs in the labelled text of a language; the fewer phrases per character, the closer the language. The automaton is a
table from state and character to the next state. Where the current phrase can't go on, the entry already leads to the
state of a new phrase that begins with the character, and is marked; so one step of the parse is one look-up, and many
texts are parsed side by side.

Texts are lower-cased and reduced to letters, and a blank for what stands between words. Each language has classes of its
own for the letters of its labelled text: one for each of the commonest, a few that the rarer ones share, and one for
letters it doesn't have, which begin a phrase each time.

Whole texts are parsed. To parse long ones side by side, each block of some hundred characters is first parsed as if a phrase
began with it. Then every block is parsed again from the state in which the block before it ended, until a phrase begins at
the same character in both parses, from where on they are one; a block without such a place hands its new last state on.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from llm.frames import add_columns, column

#: Labelled characters per language that an automaton is built of. Bounds a worker's memory to some 16 MB a language.
SAMPLE_CHARS = 24_000
#: Labelled rows per language that are read for it.
SAMPLE_ROWS = 64
#: Characters from one labelled row, so that the sample has several sources.
ROW_CHARS = 2_000
#: Characters of a block that is parsed by itself.
BLOCK = 512
#: Letters of a language with a class of their own, and classes that its other letters share.
LETTERS, SHARED = 64, 16
#: Languages that are parsed side by side.
TOGETHER = 16
#: Per phrase: how much a phrase fewer in a text raises the odds of a language. Only for the score.
ODDS = 0.5
UNDETERMINED = "und"

BLANK, UNKNOWN, OWN = 0, 1, 2


def _code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, and where each text begins."""
    strings = [x.lower() for x in text.fill_null("").to_pylist()]
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.zeros(len(strings) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in strings], out=first[1:])
    return codes, first


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Is this code point a letter?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


@dataclass
class Model:
    languages: list[str]
    kinds: np.ndarray  # from code point to kind of character: blank, a letter that no language has, or a letter
    classes: np.ndarray  # from language and kind to class of character
    table: np.ndarray  # next state * 2 + (a new phrase began), by language, state and class, in one row
    starts: np.ndarray  # first state of each language
    width: int


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """The suffix automaton of a sequence of classes as a table from state and class to the next state; 0: none."""
    most = 2 * len(text) + 2
    following = np.zeros((most, width), dtype=np.int32)
    link, length = [-1] * most, [0] * most
    last, size = 0, 1
    for c in text.tolist():
        new = size
        size += 1
        length[new] = length[last] + 1
        p = last
        while p != -1 and not following[p, c]:
            following[p, c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = int(following[p, c])
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = size
                size += 1
                length[twin], link[twin] = length[p] + 1, link[q]
                following[twin] = following[q]
                while p != -1 and following[p, c] == q:
                    following[p, c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return following[:size]


def _equal_shares(texts: list[str], total: int) -> str:
    """The texts, cut so that they have ``total`` characters together: all to the same length, shorter ones whole."""
    left, share = total, 0
    for i, size in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - i)
        if size > share:
            break
        left -= size
        share = size
    return " ".join(t[:share] for t in texts)


def build(samples: dict[str, list[str]], letters_kept: int = LETTERS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model of labelled texts by language."""
    languages = sorted(samples)
    codes = {x: _code_points(pa.array([_equal_shares(samples[x], sample_chars)], pa.string()))[0] for x in languages}
    every = np.concatenate([*codes.values(), np.zeros(0, dtype=np.uint32)])
    known = np.unique(every[letters()[every]])
    kinds = np.where(letters(), UNKNOWN, BLANK).astype(np.int32)
    kinds[known] = np.arange(len(known)) + OWN
    width = OWN + letters_kept + SHARED
    classes = np.full((len(languages), len(known) + OWN), UNKNOWN, dtype=np.uint16)
    classes[:, BLANK] = BLANK
    tables, starts, offset = [], [], 0
    for row, language in enumerate(languages):
        text = kinds[codes[language]]
        own, counts = np.unique(text[text >= OWN], return_counts=True)
        own = own[np.lexsort((own, -counts))]
        place = np.arange(len(own))
        classes[row, own] = OWN + np.where(place < letters_kept, place, letters_kept + place % SHARED)
        following = automaton(classes[row, text[_blanks_joined(text)]], width)
        # One more state, in which the next character begins a phrase whatever it is: at the start, and after characters
        # that the labelled text doesn't have.
        lost = len(following)
        again = np.where(following[0] == 0, lost, following[0])
        new = np.vstack([following == 0, np.ones((1, width), dtype=bool)])
        table = np.where(new, again, np.vstack([following, again])) + offset
        tables.append(((table << 1) | new).astype(np.int32))
        starts.append(offset + lost)
        offset += lost + 1
    table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int32)
    return Model(languages, kinds, classes, table, np.array(starts, dtype=np.int64), width)


def _blanks_joined(kinds: np.ndarray) -> np.ndarray:
    """Which characters stay if a run of blanks becomes one."""
    keep = np.ones(len(kinds), dtype=bool)
    keep[1:] = (kinds[1:] != BLANK) | (kinds[:-1] != BLANK)
    return keep


def phrases(model: Model, text: pa.Array, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of each text by language, characters parsed, and whether there is a letter."""
    codes, first = _code_points(text)
    kinds = model.kinds[codes]
    keep = _blanks_joined(kinds)
    keep[first[(first > 0) & (first < len(kinds))]] = True
    kinds = kinds[keep]
    first = np.concatenate([[0], np.cumsum(keep)])[first]
    sizes = np.diff(first)
    has_letter = np.concatenate([[0], np.cumsum(kinds != BLANK)])
    has_letter = has_letter[first[1:]] > has_letter[first[:-1]]
    n_blocks = -(-sizes // block)
    owner = np.repeat(np.arange(len(sizes)), n_blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = first[owner] + nth * block
    size = np.minimum(first[owner + 1] - start, block)
    out = np.zeros((len(sizes), len(model.languages)), dtype=np.int64)
    for low in range(0, len(model.languages), TOGETHER):
        some = slice(low, low + TOGETHER)
        np.add.at(out[:, some], owner, _parse(model, some, kinds, start, size, nth > 0, block).T)
    return out, sizes, has_letter


def _parse(model: Model, some: slice, kinds: np.ndarray, start: np.ndarray, size: np.ndarray, follows: np.ndarray, block: int) -> np.ndarray:
    """Phrases of each block by language, as they come out of a parse of whole texts."""
    classes = model.classes[some][:, kinds]
    lost = model.starts[some]
    # Each block by itself, the longest first, so that those that go on are in front.
    order = np.argsort(-size, kind="stable")
    starts, live = start[order], len(order)
    ends = np.searchsorted(-size[order], -np.arange(block), side="left")  # blocks longer than the step
    state = np.repeat(lost[:, None], len(order), axis=1)
    count = np.zeros(state.shape, dtype=np.int64)
    began = np.zeros(classes.shape, dtype=bool)
    for step in range(block):
        live = ends[step]
        if not live:
            break
        at = starts[:live] + step
        entry = model.table[state[:, :live] * model.width + classes[:, at]]
        new = (entry & 1).astype(bool)
        began[:, at] = new
        count[:, :live] += new
        state[:, :live] = entry >> 1
    alone = np.empty_like(state)
    alone[:, order] = state
    total = np.empty_like(count)
    total[:, order] = count
    # Again, from where the block before ended.
    more, last = np.zeros_like(count), alone.copy()
    row, at_block = np.nonzero(np.broadcast_to(follows, count.shape))
    while len(row):
        more[row, at_block] = 0
        found = alone[row, at_block]
        now, active = last[row, at_block - 1], np.arange(len(row))
        step = 0
        while len(active):
            r, b = row[active], at_block[active]
            at = start[b] + step
            entry = model.table[now * model.width + classes[r, at]]
            new, before = (entry & 1).astype(bool), began[r, at]
            more[r, b] += new.astype(np.int64) - before
            now = entry >> 1
            step += 1
            apart = ~(new & before)
            over = apart & (size[b] <= step)
            found[active[over]] = now[over]
            goes_on = apart & ~over
            active, now = active[goes_on], now[goes_on]
        changed = found != last[row, at_block]
        last[row, at_block] = found
        after = at_block[changed] + 1
        inside = after < len(follows)
        row, at_block = row[changed][inside], after[inside]
        within = follows[at_block]
        row, at_block = row[within], at_block[within]
    return total + more


def sample(docs: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS, languages: int = 1000) -> dict[str, list[str]]:
    """Texts of at most ``rows`` rows for each language: those with the smallest hash of their key.

    Of a text, up to ``row_chars`` characters in one piece, which begins at a place that the hash gives.

    Rows without a language or with a null or empty text teach nothing. More than ``languages`` languages are refused.
    """
    order = Window.partitionBy("language").orderBy("hash", "key")
    hashed = F.xxhash64(column(key).cast("string"))
    begin = F.pmod(hashed, F.greatest(F.length(column(text)) - row_chars, F.lit(0)) + 1).cast("int") + 1
    narrow = docs.filter(column(language).isNotNull() & (F.length(column(text)) > 0)).select(
        column(language).cast("string").alias("language"), hashed.alias("hash"), column(key).cast("string").alias("key"), F.substring(column(text), begin, F.lit(row_chars)).alias("text")
    )
    chosen = narrow.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows).select("language", "hash", "key", "text")
    most = rows * languages
    found = sorted(chosen.limit(most + 1).collect(), key=lambda r: (r.language, r.hash, r.key or "", r.text))
    if len(found) > most:
        raise ValueError(f"more than {languages} languages")
    out: dict[str, list[str]] = {}
    for row in found:
        out.setdefault(row.language, []).append(row.text)
    return out


def train(docs: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """A model learned from a bounded sample (see ``sample``) of labelled documents."""
    return build(sample(docs, text, language, key, rows))


NEW = [
    T.StructField("lang_pred", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("phrases_per_char", T.DoubleType(), True),
]


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``phrases_per_char`` of the winner, from the whole text alone.

    The language with the fewest phrases wins; ties go to the first name. ``score`` is its share of the odds, 0 to 1.
    A text that is null or has no letter, and every text if no language was learned, is ``und`` with score 0 and null
    phrases. Repeated rows are judged each; an empty table gives an empty table. Columns in ``carry`` (None: all) stay,
    except those named like the new ones, which are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows():
        model = shared.value

        def compute(column: pa.Array) -> list[pa.Array]:
            count, sizes, has_letter = phrases(model, column)
            if not model.languages:
                return [pa.array([UNDETERMINED] * len(sizes)), pa.array(np.zeros(len(sizes))), pa.nulls(len(sizes), pa.float64())]
            best = count.argmin(axis=1)
            least = count.min(axis=1)
            share = 1 / np.exp(np.maximum(ODDS * (least[:, None] - count), -700)).sum(axis=1)
            names = [model.languages[b] if known else UNDETERMINED for b, known in zip(best, has_letter)]
            rate = pa.array(least / np.maximum(sizes, 1), mask=~has_letter)
            return [pa.array(names, pa.string()), pa.array(np.where(has_letter, share, 0.0)), rate]

        return compute

    return add_columns(docs, text, carry, NEW, rows)


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1):
    """Is the row in the held-out fold? A null key isn't."""
    return F.coalesce(F.crc32(column(key).cast("string")) % folds == fold, F.lit(False))
