"""Problem 5: variant spellings of names typed by people, by weighted character n-grams and average linkage.

What words mean is learned from the groups that the table already has: words that are put in place of one another inside
groups are one word (short forms, short given names), words that come and go inside groups say nothing (legal forms, titles),
and the other words that many groups share are kinds (lines of business, given names), in which names must agree. The rest of
a name, its core, becomes a sparse vector of character n-grams, weighted by inverse document frequency.

All names of one kind are compared in blocks, and none that may be within the edits allowed is turned away: sketches of letters
and of the letters that follow one another tell how many edits two cores are apart at least, then the edits are counted. Of
the pairs that are left cosines are exact. Ungrouped names are clustered by average linkage, and a cluster goes to the group of
greatest average linkage to it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_unique
from ..plans.storage import Scratch
from .words import normal_text, once

# Words of company forms, articles and titles, general ones; those of a table's own are learned from it.
LEGAL = (
    "ab ag aps as asa bv co company corp corporation cv doo eirl gmbh gbr holding holdings inc incorporated kg kft kk lda limited llc llp lp ltd ltda mbh nv oao ohg ou oy oyj pao partnership plc pte pty pvt "
    "sa sarl sas se sia sl spa spzoo srl srls sro tbk the uab ug und and et mr mrs ms miss mx dr prof sir madam herr frau sr sra mme mlle"
).split()
# Given names and the short forms people use for them.
SHORT_FORMS = """
albert: bert; alexander: alec alex sandy xander; andrew: andy drew; anthony: tony; barbara: barb babs; benjamin: ben benny; catherine: cathy; charles: charlie chuck; christopher: chris kit topher;
daniel: dan danny; david: dave davy; deborah: deb debbie; dorothy: dolly dot dottie; edward: eddie ned; eleanor: ellie nell nora; elizabeth: beth betsy betty eliza libby liz lizzie; eugene: gene;
frances: fran frannie; francis: frank; frederick: fred freddie fritz; gerald: gerry jerry; gregory: greg; gwendolyn: gwen wendy; harold: hal; henrietta: etta hattie; henry: hank harry; isabella: bella izzy;
jacob: jake; james: jamie jim jimmy; jennifer: jen jenny; jessica: jess jessie; john: jack johnny; jonathan: jon; joseph: joe joey; josephine: jo josie; joshua: josh; judith: judy; katherine: kate kathy katie kay;
kenneth: ken kenny; lawrence: larry; leonard: len lenny leo; margaret: greta maggie marge meg peggy; matthew: matt; michael: mick mickey mike; nathaniel: nat nate; nicholas: nick nicky; oswald: oz ozzie;
pamela: pam; patricia: pat patsy tricia trish; peter: pete; philip: phil; raymond: ray; rebecca: becca becky; richard: dick rich rick; robert: bob bobby rob robbie; ronald: ron ronnie; samuel: sam sammy;
stephen: steve; susan: sue susie; susannah: sukie suzy; theodore: ted teddy theo; thomas: tom tommy; timothy: tim; victoria: tori vicky; vincent: vince; walter: walt; william: bill billy will willie; yolanda: yoli; zachary: zach zack
"""  # fmt: skip
NICKNAMES = {short: name for names in SHORT_FORMS.replace("\n", " ").split(";") for name, _, shorts in [names.strip().partition(":")] for short in shorts.split()}

#: A word is common in a table where at least 1/COMMON of the groups have it, a habit of groups where 1/HABIT of them show it;
#: at the least 5 and 3. So at most COMMON x words of a name are common.
COMMON, HABIT, FEW_COMMON, FEW_HABIT = 2000, 5000, 5, 3
#: Slips (letters left out, put in, replaced or swapped) that a name of any length may have.
SLIPS = 2
#: N-grams of more than 1/RARE of the names have their own weight.
RARE = 1000
#: Cores that a task compares with as many others; pairs that it looks at at once, and in parts that stay in fast memory; letters
#: of a core that a word of the machine holds.
BLOCK, AT_ONCE, FAST, WORD = 1 << 15, 1 << 17, 1 << 12, 64
#: Edits as a share of the longer core; average linkage that names need to be one cluster, and to go to a group.
MAX_EDITS, CLUSTER, FLOOR = 0.3, 0.5, 0.05
WIDE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"
ACCENTS = re.compile("[\u0300-\u036f]")
PARSED = "struct<kind:string,given:string,core:string>"
MIX = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class Vocabulary(NamedTuple):
    """What words stand for: same maps a word to the one it means, loose words say nothing, lines and given are kinds."""

    same: dict[str, str]
    loose: frozenset[str]
    lines: frozenset[str]
    given: frozenset[str]


def learn(forms: DataFrame, scratch: Scratch) -> Vocabulary:
    """The vocabulary of forms (gid, norm, n, own), the different normal texts of each group; own marks its label's.

    Each form is compared with its group's main one, the label's or else the most frequent. A word put for another in enough
    groups means that one where it does so mostly; words left out or added in enough groups are loose; other common words are
    kinds, and given names where their initials are put for them. General knowledge stands where the table says nothing.
    """
    words = lambda c: F.split(c, " ")
    main = scratch.write(forms.groupBy("gid").agg(F.max_by("norm", F.struct("own", "n", "norm")).alias("main"), F.count("*").alias("forms")))
    total = main.count()
    common = main.select(F.explode(F.array_distinct(words("main"))).alias("w")).groupBy("w").agg(F.count("*").alias("k")).where(F.col("k") >= max(FEW_COMMON, total / COMMON))
    common_words = {r["w"] for r in common.collect()}
    both = join_unique(forms, main.where("forms > 1"), ["gid"], "forms", scratch=scratch).where("norm != main").select("gid", words("norm").alias("o"), words("main").alias("m"))
    both = both.select("gid", F.array_except("m", "o").alias("gone"), F.array_except("o", "m").alias("new"))
    one = lambda what, old, new: F.struct(F.lit(what).alias("what"), old.alias("old"), new.alias("new"))
    nothing, swap = F.lit(""), (F.size("gone") == 1) & (F.size("new") == 1)
    seen = F.when(swap, F.array(one("swap", F.col("gone")[0], F.col("new")[0])))
    seen = seen.when(F.size("new") == 0, F.transform("gone", lambda w: one("gone", w, nothing))).when(F.size("gone") == 0, F.transform("new", lambda w: one("new", nothing, w)))
    habits = both.select("gid", F.explode(seen).alias("e")).select("gid", "e.*").distinct().groupBy("what", "old", "new").agg(F.count("*").alias("k"))
    # at most HABIT x the habits of a group
    rows = habits.where(F.col("k") >= max(FEW_HABIT, total / HABIT)).collect()

    loose = {w for r in rows if r["what"] != "swap" for w in (r["old"] or r["new"],) if len(w) > 1} | {*LEGAL}
    swaps = [(r["new"], r["old"], r["k"]) for r in rows if r["what"] == "swap" and r["old"] in common_words]
    initials = {old for new, old, _ in swaps if len(new) == 1 and new == old[0] and old not in loose}
    meant: dict[str, list[tuple[int, str]]] = {}
    for new, old, k in swaps:
        if len(new) > 1 and new not in common_words:
            meant.setdefault(new, []).append((k, old))
    same = {new: max(of)[1] for new, of in meant.items() if 2 * max(of)[0] > sum(k for k, _ in of)}
    given = initials | ({*NICKNAMES.values()} - loose)
    same = {s: n for s, n in NICKNAMES.items() if s not in common_words} | same
    loose |= {s for s, n in same.items() if n in loose}
    return Vocabulary(same, frozenset(loose), frozenset(w for w in common_words if w not in loose and w not in given and len(w) > 1), frozenset(given))


def bare(text: str) -> str:
    """Letters without accents, which people leave out; marks of other scripts than European ones stay."""
    return unicodedata.normalize("NFC", ACCENTS.sub("", unicodedata.normalize("NFD", text)))


def parse(norm: pa.Array, known: Vocabulary) -> pa.Array:
    """struct(kind, given, core) of normal texts, null without a core.

    The kind is the line of business or form, for persons their given name's initial, otherwise empty. Of single letters the
    first counts, as an initial, and only where there is no given name and no line. The core are the other words as they stand,
    without accents.
    """
    known_words = [*{*known.same, *known.loose, *known.lines, *known.given}]
    means = [known.same.get(w, w) for w in known_words]
    type_of = np.array([1 if w in known.loose else 2 if w in known.lines else 3 if w in known.given else 0 for w in means] or [0], np.int8)
    texts = pc.split_pattern(norm, " ")
    flat, offsets = texts.flatten(), texts.offsets.to_numpy()
    row = np.repeat(np.arange(len(norm)), np.diff(offsets))
    code = pc.index_in(flat, pa.array(known_words, pa.string())) if known_words else pa.nulls(len(flat), pa.int32())
    at = pc.fill_null(code, -1).to_numpy()
    word = pc.coalesce(pa.array(means or [""], pa.string()).take(code), flat)
    kind = np.where(at >= 0, type_of[at], 0)
    letter = (kind == 0) & (pc.utf8_length(flat).to_numpy() == 1) & ~pc.match_substring_regex(flat, WIDE).to_numpy(zero_copy_only=False)
    n = len(norm)
    has = lambda mask: np.bincount(row[mask], minlength=n) > 0
    line_rows, given_rows = has(kind == 2), has(kind == 3)
    core = ((kind == 0) & ~letter) | ((kind == 3) & line_rows[row])
    core |= letter & ~has(core)[row]
    first = {}
    for name, mask in (("given", (kind == 3) & ~line_rows[row]), ("letter", letter & ~line_rows[row] & ~given_rows[row])):
        rows, places = np.unique(row[mask], return_index=True)
        first[name] = dict(zip(rows.tolist(), word.take(pa.array(np.flatnonzero(mask)[places])).to_pylist(), strict=True))
    lines: dict[int, str] = {}
    for r, w in sorted({*zip(row[kind == 2].tolist(), word.filter(pa.array(kind == 2)).to_pylist(), strict=True)}):
        lines[r] = f"{lines[r]} {w}" if r in lines else w
    given = [first["given"].get(i, "") for i in range(n)]
    kinds = [lines.get(i) or ((g or first["letter"].get(i, ""))[:1] and "~" + (g or first["letter"][i])[0]) for i, g in enumerate(given)]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[core], minlength=n)))).astype(np.int32)
    cores = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), word.filter(pa.array(core))), " ")
    accented = pc.invert(pc.string_is_ascii(cores))
    cores = pc.replace_with_mask(cores, accented, pa.array([bare(c) for c in cores.filter(accented).to_pylist()], pa.string()))
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(given, pa.string()), cores], ["kind", "given", "core"], mask=pa.array(np.diff(ends) == 0))


def parsed(norm: Column | str, known: Vocabulary) -> Column:
    return F.arrow_udf(lambda column: parse(column, known), PARSED)(norm)


class Letters(NamedTuple):
    """The code points of many strings in one row, the string of each, and where each string begins and ends."""

    points: np.ndarray
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Letters:
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(length)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        return Letters(points, np.repeat(np.arange(len(texts)), length), end - length, end)

    def rolling(self, size: int) -> np.ndarray:
        """Hashes of 48 bits of the `size` letters from each place on, whatever string they are of."""
        n = max(len(self.points) - size + 1, 0)
        return _hash([self.points[i : i + n] for i in range(size)], n)

    def inside(self, size: int) -> np.ndarray:
        """Places from which `size` letters of one string follow."""
        n = max(len(self.points) - size + 1, 0)
        return np.flatnonzero(np.arange(n) + size <= self.end[self.row[:n]])


def _hash(letters: list[np.ndarray], n: int) -> np.ndarray:
    h = np.full(n, len(letters), np.uint64)
    for i, x in enumerate(letters):
        h = (h ^ x) * MIX[i % len(MIX)]
        h ^= h >> np.uint64(29)
    return h >> np.uint64(16)


def _run(core: str) -> str:
    return core.replace(" ", "")


def _turned(core: str) -> str:
    return "".join(reversed(core.split(" ")))


def part_size(length: int) -> tuple[int, int]:
    """(number, size) of the parts that a core of that length is held under: one more than the slips that are looked for, which
    are fewer for cores too short for parts of two letters."""
    number = SLIPS + 1 if length >= 2 * (SLIPS + 1) else 2 if length > 3 else 1
    return number, max(1, length // number)


def _distinct(row: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a row below n and a hash, sorted by row."""
    if n > 1 << 16:  # a batch larger than any usual one
        order = np.lexsort((values, row))
        row, values = row[order], values[order]
        keep = np.concatenate(([True], (row[1:] != row[:-1]) | (values[1:] != values[:-1]))) if len(row) else np.zeros(0, bool)
        return row[keep], values[keep]
    both = np.sort(row.astype(np.uint64) << np.uint64(48) | values)
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)


def _listed(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values, sorted by row, as a list column of LONGs."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def held_keys(cores: list[str]) -> pa.Array:
    """Hashes of the parts of each core, and of the first and the last one as they are when letters were swapped over their inner
    ends: a swap there spoils two parts, and so with another slip all three."""
    letters = Letters.of([_run(c) for c in cores])
    length = letters.end - letters.begin
    sizes = np.array([part_size(n) for n in range(int(length.max(initial=0)) + 1)], np.int64)[length].reshape(-1, 2)
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in np.unique(sizes[length > 0, 1]).tolist():
        at = np.flatnonzero((sizes[:, 1] == size) & (length > 0))
        number, begin, whole = sizes[at, 0], letters.begin[at], letters.rolling(size)
        for i in range(SLIPS + 1):
            has = number > i
            rows.append(at[has])
            keys.append(whole[begin[has] + i * size])
        has = number > 1
        swapped = [letters.points[begin[has] + i] for i in (*range(size - 1), size)]
        rows.append(at[has])
        keys.append(_hash(swapped, int(has.sum())))
        has = number > 2
        last = begin[has] + (number[has] - 1) * size
        swapped = [letters.points[last + i] for i in (-1, *range(1, size))]
        rows.append(at[has])
        keys.append(_hash(swapped, int(has.sum())))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return _listed(row[order], np.concatenate(keys)[order], len(cores))


def probe_keys(cores: list[str]) -> pa.Array:
    """Hashes of all n-grams of each core, in either order of its words, that a core within so many slips may be held under."""
    both = Letters.of([t for c in cores for t in (_run(c), _turned(c))])
    length = both.end - both.begin
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    wanted = [{part_size(x)[1] for x in range(max(1, n - SLIPS), n + SLIPS + 1)} for n in range(int(length.max(initial=0)) + 1)]
    for size in sorted(set().union(*wanted)) if wanted else []:
        asks = np.array([size in w for w in wanted])[length]
        at = both.inside(size)
        at = at[asks[both.row[at]]]
        rows.append(both.row[at] // 2)
        keys.append(both.rolling(size)[at])
    return _listed(*_distinct(np.concatenate(rows), np.concatenate(keys), len(cores)), len(cores))


def sketch(cores: list[str]) -> pa.Array:
    """64 bits of the letters of each core, for each of 32 places one that says it is there and one that it is there twice. A slip
    changes two bits at most, and neither the order of letters nor that of words matters."""
    letters = Letters.of([_run(c) for c in cores])
    times = np.bincount(letters.row * 32 + (letters.points & np.uint64(31)).astype(np.int64), minlength=32 * len(cores)).reshape(-1, 1, 32)
    bits = np.packbits(times >= np.array([[1], [2]]), axis=2, bitorder="little")
    return pa.array(bits.reshape(-1, 8).view(np.int64).ravel())


def gram_hashes(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct character n-grams within the words of each core: of three letters, in Han and syllabaries of
    two; a shorter word is its own only one."""
    letters = Letters.of(cores)
    wide = pc.match_substring_regex(pa.array(cores, pa.string()), WIDE).to_numpy(zero_copy_only=False)
    short = pc.match_substring_regex(pa.array(cores, pa.string()), r"(^| ).{1,2}( |$)").to_numpy(zero_copy_only=False)
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for of, size in ((~wide, 3), (wide, 2)):
        at = letters.inside(size) if of.any() else np.zeros(0, np.int64)
        at = at[of[letters.row[at]]]
        for i in range(size):
            at = at[letters.points[at + i] != 32]
        rows.append(letters.row[at])
        hashes.append(letters.rolling(size)[at])
        for r in np.flatnonzero(of & short).tolist():
            for w in cores[r].split(" "):
                if 0 < len(w) < size:
                    rows.append(np.array([r]))
                    hashes.append(Letters.of([w]).rolling(len(w)))
    return _distinct(np.concatenate(rows), np.concatenate(hashes), len(cores))


class Weights(NamedTuple):
    """Inverse document frequencies: of the n-grams in more than 1/RARE of the names by hash, and that of all others."""

    hashes: np.ndarray
    values: np.ndarray
    rest: float

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), self.rest)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at], self.rest)


def gram_weights(points: DataFrame) -> Weights:
    """Weights over all points. The driver gets at most RARE x the n-grams of a name."""
    total = points.count()
    rest = math.log(1 + min(RARE, max(total, 1)))

    def count(batches):
        for b in batches:
            grams, k = np.unique(gram_hashes(b.column(0).to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(k)], names=["g", "k"])

    sums = points.select("core").mapInArrow(count, "g long, k long").groupBy("g").agg(F.sum("k").alias("k")).where(F.col("k") * RARE > total)
    rows = sums.collect() if total > RARE else []
    hashes = np.array([r["g"] for r in rows], np.int64).view(np.uint64)
    values = np.array([math.log(1 + total / r["k"]) for r in rows])
    order = np.argsort(hashes)
    return Weights(hashes[order], values[order], rest)


def cosines(a: list[str], b: list[str], weights: Weights) -> np.ndarray:
    """The cosine of the n-gram vectors of each two cores."""
    sides = []
    for cores in (a, b):
        row, h = gram_hashes(cores)
        w = weights.of(h)
        norm = np.sqrt(np.bincount(row, w * w, minlength=len(cores)))
        sides.append((row, h, w / np.maximum(norm[row], 1e-12)))
    (ra, ha, wa), (rb, hb, wb) = sides
    if len(a) > 1 << 16:
        half = len(a) // 2
        return np.concatenate((cosines(a[:half], b[:half], weights), cosines(a[half:], b[half:], weights)))
    key = lambda r, h: r.astype(np.uint64) << np.uint64(48) | h
    ka, kb = key(ra, ha), key(rb, hb)  # both sorted
    at = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
    met = np.flatnonzero(kb[at] == ka) if len(kb) else np.zeros(0, np.int64)
    return np.bincount(ra[met], wa[met] * wb[at[met]], minlength=len(a))


def most_edits(length: int) -> int:
    """The most edits within which two cores can be one another's variants by their number, the longer one having so many letters."""
    return max(SLIPS, *(e for e in range(int(MAX_EDITS * length) + 2) if e <= SLIPS or e / length <= MAX_EDITS))


def following(runs: list[str]) -> np.ndarray:
    """256 bits, in a row of four numbers, of each two letters that follow one another. An edit takes two away at most."""
    letters = Letters.of(runs)
    at = letters.inside(2)
    has = np.zeros((len(runs), 256), bool)
    has[letters.row[at], (letters.rolling(2)[at] & np.uint64(255)).astype(np.int64)] = True
    return np.packbits(has, axis=1, bitorder="little").view(np.uint64)


class Runs(NamedTuple):
    """Cores written without spaces in one order of words: letters modulo 32 by place, by letter the bits of its places, and the
    bits of letters that follow one another. Letters beyond a machine's word are cut off, so edits of longer ones can't be counted."""

    letters: np.ndarray
    places: np.ndarray
    follow: np.ndarray

    @staticmethod
    def of(runs: list[str]) -> Runs:
        of = Letters.of([r[:WORD] for r in runs])
        place = np.arange(len(of.points)) - of.begin[of.row]
        letter = (of.points & np.uint64(31)).astype(np.int64)
        letters = np.zeros((int(place.max(initial=-1)) + 1, len(runs)), np.int64)
        letters[place, of.row] = letter
        places = np.zeros(32 * len(runs), np.uint64)
        np.add.at(places, 32 * of.row + letter, np.uint64(1) << place.astype(np.uint64))  # no bit twice
        return Runs(letters, places, following(runs))

    def edits(self, a: np.ndarray, n: int, other: Runs, b: np.ndarray, m: int) -> np.ndarray:
        """Levenshtein distances, letters modulo 32, of these cores at a, of n letters each, and the other's at b, of m: columns
        of the table of distances are differences in bits, all pairs at a time (Myers)."""
        one, last, base = np.uint64(1), np.uint64(m - 1), 32 * b
        up, down, distance = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64), np.full(len(a), m, np.uint64)
        x, across, more, less = (np.empty(len(a), np.uint64) for _ in range(4))
        for i in range(n):
            equal = other.places.take(base + self.letters[i].take(a))
            np.bitwise_or(equal, down, out=x)
            np.bitwise_and(equal, up, out=across)
            across += up
            across ^= up
            across |= equal
            np.bitwise_or(across, up, out=more)
            np.invert(more, out=more)
            more |= down
            np.bitwise_and(up, across, out=less)
            distance += np.bitwise_and(np.right_shift(more, last, out=equal), one, out=equal)
            distance -= np.bitwise_and(np.right_shift(less, last, out=equal), one, out=equal)
            more <<= one
            more |= one
            less <<= one
            np.bitwise_or(x, more, out=up)
            np.invert(up, out=up)
            up |= less
            np.bitwise_and(more, x, out=down)
        return distance


class Word(NamedTuple):
    """The sketch of one word of each core, and how many letters it may have that its counterpart lacks."""

    bits: np.ndarray
    limit: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Word:
        length = np.fromiter(map(len, words), np.int64, len(words))
        return Word(sketch(words).to_numpy().view(np.uint64), np.clip(length // 4 + 1, SLIPS, 64).astype(np.uint8))

    def fits(self, i: np.ndarray, other: Word, j: np.ndarray) -> np.ndarray:
        a, b = self.bits.take(i), other.bits.take(j)
        differ = a ^ b
        lacks = np.maximum(np.bitwise_count(np.bitwise_and(a, differ, out=a)), np.bitwise_count(np.bitwise_and(b, differ, out=b)))
        return lacks <= np.maximum(self.limit.take(i), other.limit.take(j))


def close_pairs(cores: list[str], asked: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (q, f) of cores, q one of asked and f one of others, of all pairs that can pass the checks by edits and of some more.

    Nothing that passes is left out: of two cores within k edits each has k letters at most that the other lacks, in any order of
    words, and 2 k of those that follow one another in all orders while the other has them in none. Of two cores of two words the
    same goes for the words and what each is allowed, unless all letters are the same. Cores of the same letters but two need no
    count of edits. Where a core is too long for a machine's word its edits aren't counted here.
    """
    words = [c.split(" ") for c in cores]
    runs = [["".join(w) for w in words], ["".join(w[::-1]) for w in words], ["".join(sorted(w)) for w in words]]
    length = np.fromiter(map(len, runs[0]), np.int64, len(cores))
    bits = sketch(cores).to_numpy().view(np.uint64)
    number = np.bitwise_count(bits).astype(np.int64)
    plain, turned, ordered = (Runs.of(r) for r in runs)
    always, ever = plain.follow & turned.follow & ordered.follow, plain.follow | turned.follow | ordered.follow
    two = np.fromiter((len(w) == 2 for w in words), bool, len(cores))
    first, second = Word.of([w[0] for w in words]), Word.of([w[-1] for w in words])
    in_order, in_turn, either = (np.fromiter(map(str.__eq__, runs[i], runs[j]), bool, len(cores)) for i, j in ((2, 0), (2, 1), (0, 1)))
    # with where the runs are those of an order before
    orders = [
        (plain, plain, lambda q, f: np.zeros(len(q), bool)),
        (plain, turned, lambda q, f: either[f]),
        (turned, plain, lambda q, f: either[q]),
        (ordered, ordered, lambda q, f: in_order[q] & (in_order[f] | in_turn[f]) | in_turn[q] & in_order[f]),
    ]

    def lost(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a.take(i, 0) & ~b.take(j, 0)).sum(1, dtype=np.uint16)

    def by_word(q: np.ndarray, f: np.ndarray) -> np.ndarray:
        fit = ~(two.take(q) & two.take(f))
        for a, b in ((first, second), (second, first)):
            at = np.flatnonzero(~fit)
            at = at[first.fits(q[at], a, f[at])]
            fit[at[second.fits(q[at], b, f[at])]] = True
        return fit

    def parts(places: np.ndarray) -> list[np.ndarray]:
        return np.split(places, range(FAST, len(places), FAST))

    def counted(q: np.ndarray, f: np.ndarray, n: int, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        def follows(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, of: np.ndarray) -> np.ndarray:
            """Those of the pairs of whose letters that follow one another few enough of a are not in b, and of c not in d."""
            kept = []
            for at in parts(of):
                at = at[lost(a, q[at], b, f[at]) <= 2 * k]
                kept.append(at[lost(c, f[at], d, q[at]) <= 2 * k])
            return np.concatenate(kept)

        near = follows(always, ever, always, ever, np.arange(len(q)))
        if max(n, m) > WORD:
            return q[near], f[near]
        few = np.zeros(len(q), bool)
        for a, b, again in orders:
            left = near[~few[near]]
            left = left[~again(q[left], f[left])]
            for at in parts(follows(a.follow, b.follow, b.follow, a.follow, left)):
                few[at] = a.edits(q[at], n, b, f[at], m) <= k
        return q[few], f[few]

    room = max(AT_ONCE, len(others))
    pairs, share, low = np.empty(room, np.uint64), np.empty(room, np.uint8), np.empty(room, bool)

    def alike(ask: np.ndarray, of: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs of which neither has more than k letters that the other lacks, and twice the most that one lacks."""
        waiting: list[tuple[np.ndarray, ...]] = []
        there, step, count = bits[of], max(1, AT_ONCE // len(of)), 0
        for ones in np.unique(number[ask]).tolist():
            same = ask[number[ask] == ones]
            more = np.abs(number[of] - ones).astype(np.uint8)
            beyond = np.maximum(2 * k + 1 - more.astype(np.int64), 0).astype(np.uint8)
            for begin in range(0, len(same), step):
                some = same[begin : begin + step]
                shape, size = (len(some), len(of)), len(some) * len(of)
                differ, apart, near = (x[:size].reshape(shape) for x in (pairs, share, low))
                np.bitwise_xor(bits[some][:, None], there, out=differ)
                np.less(np.bitwise_count(differ, out=apart), beyond, out=near)
                at = np.flatnonzero(near)
                q, f = np.divmod(at, len(of))
                waiting.append((some[q], of[f], share[at] + more[f]))
                count += len(at)
                if count > AT_ONCE // 2:
                    yield tuple(map(np.concatenate, zip(*waiting, strict=True)))
                    waiting, count = [], 0
        if count:
            yield tuple(map(np.concatenate, zip(*waiting, strict=True)))

    held = {n: others[length[others] == n] for n in np.unique(length[others]).tolist()}
    for n in np.unique(length[asked]).tolist():
        ask = asked[length[asked] == n]
        for m, of in held.items():
            k = most_edits(max(n, m))
            if abs(n - m) > k:
                continue
            for q, f, apart in alike(ask, of, k):
                fit = by_word(q, f) | (apart == 0)
                q, f, same = q[fit], f[fit], apart[fit] <= 2 * SLIPS
                yield q[same], f[same]
                yield counted(q[~same], f[~same], n, m, k)


class Copies(NamedTuple):
    """The rows of some points by the code of their core: rows of one core follow one another, number of them from begin on."""

    rows: np.ndarray
    number: np.ndarray
    begin: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, code: np.ndarray, codes: int) -> Copies:
        number = np.bincount(code[rows], minlength=codes)
        return Copies(rows[np.argsort(code[rows], kind="stable")], number, np.cumsum(number) - number)

    def products(self, q: np.ndarray, other: Copies, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows of each two cores, all with all, so many at a time."""
        times = self.number[q] * other.number[f]
        ends = np.cumsum(times)
        for begin in range(0, int(times.sum()), AT_ONCE):
            flat = np.arange(begin, min(begin + AT_ONCE, int(ends[-1])))
            pair = np.searchsorted(ends, flat, side="right")
            x, y = np.divmod(flat - (ends - times)[pair], other.number[f[pair]])
            yield self.rows[self.begin[q[pair]] + x], other.rows[other.begin[f[pair]] + y]


def met_pairs(points: DataFrame, scratch: Scratch) -> DataFrame:
    """(q, f): ids of asked points and others of their kind, all that can pass the check by edits, each pair once.

    Those of a kind are parted into blocks by a hash, and each two blocks are a task's work: memory is bounded by the blocks, and
    the work grows as the asked names of a kind times all its names.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = points.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("gid").isNull()).alias("asked")).where("asked > 0")
    rows = join_unique(points.select("id", "kind", "core", F.col("gid").isNull().alias("ask")), sizes, ["kind"], "n", scratch=scratch)
    at = lambda c: F.pmod(F.xxhash64("id"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    held = rows.select("kind", at("n").alias("x"), every("asked").alias("y"), "id", "core", F.lit(False).alias("ask"))
    asked = rows.where("ask").select("kind", every("n").alias("x"), at("asked").alias("y"), "id", "core", "ask")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        ids, ask = group.column("id").to_numpy(), group.column("ask").to_numpy()
        core = pa.concat_arrays(group.column("core").chunks).dictionary_encode()  # what is asked is one of the others as well
        code, codes = core.indices.to_numpy().astype(np.int64), len(core.dictionary)
        asked, others = (Copies.of(np.flatnonzero(of), code, codes) for of in (ask, ~ask))
        for pairs in close_pairs(core.dictionary.to_pylist(), *(np.flatnonzero(of.number) for of in (asked, others))):
            for q, f in asked.products(pairs[0], others, pairs[1]):
                differ = ids[q] != ids[f]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[differ]]), pa.array(ids[f[differ]])], names=["q", "f"])

    return held.unionByName(asked).groupBy("kind", "x", "y").applyInArrow(meet, "q long, f long")


def near_pairs(points: DataFrame, weights: Weights, scratch: Scratch) -> DataFrame:
    """(q, f, cos, edits, share) of asked points and others of their kind that pass the check by edits.

    points is (id, gid, kind, given, core, n); gid is null for what is asked.
    """
    met = met_pairs(points, scratch)
    side = lambda of, name: points.select(F.col("id").alias(name), F.col("given").alias(f"g{name}"), F.col("core").alias(f"c{name}")) if of is None else of
    rows = met.join(side(None, "f"), "f").join(points.where("gid is null").select(F.col("id").alias("q"), F.col("given").alias("gq"), F.col("core").alias("cq")), "q")
    rows = rows.where((F.col("gq") == "") | (F.col("gf") == "") | (F.col("gq") == F.col("gf")))
    split, sort = lambda c: F.split(c, " "), lambda c: F.array_sort(F.split(c, " "))
    joined = lambda a: F.array_join(a, "")
    runs = [(split("cq"), split("cf")), (split("cq"), F.reverse(split("cf"))), (F.reverse(split("cq")), split("cf")), (sort("cq"), sort("cf"))]
    each = [F.levenshtein(joined(a), joined(b)) for a, b in runs]
    rows = once(rows, "edits", F.when(each[0] <= SLIPS, each[0]).otherwise(F.least(*each))).withColumn("share", F.col("edits") / F.greatest(F.length(joined(split("cq"))), F.length(joined(split("cf")))))
    size = lambda a, b: F.greatest(F.length(a), F.length(b))
    letters = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    # letters that only changed places count less
    moved = lambda a, b, e: (e <= size(a, b) / 2 + 1) & (F.levenshtein(letters(a), letters(b)) <= 2)
    rows = rows.where((F.col("edits") <= SLIPS) | (F.col("share") <= MAX_EDITS) | moved(joined(split("cq")), joined(split("cf")), F.col("edits")))
    # word for word, as far as there are as many: no word may be another one
    one = lambda a, b: (F.levenshtein(a, b) <= size(a, b) / 4 + 1) | moved(a, b, F.levenshtein(a, b))
    alike = lambda a, b: F.forall(F.zip_with(a, b, one), lambda ok: F.coalesce(ok, F.lit(False)))
    same_words = F.lit(False)
    for a, b in runs:
        same_words = same_words | alike(a, b)
    rows = rows.where((F.size(split("cq")) != F.size(split("cf"))) | (F.col("edits") == 0) | same_words)
    cos = F.arrow_udf(lambda a, b: pa.array(cosines(a.to_pylist(), b.to_pylist(), weights)), "double")("cq", "cf")
    return rows.withColumn("cos", cos).select("q", "f", "cos", "edits", "share")


def average_linkage(edges: DataFrame, scratch: Scratch, least: float = CLUSTER) -> DataFrame:
    """(id, cluster) of the points of edges (a, b, s), each pair once: clusters of average linkage, pairs without an edge being 0.

    A round unites each two clusters that are one another's nearest; average linkage is reducible, so that is what uniting the
    nearest two of all, one after the other, comes to. Sums of similarities add up when clusters are united. It ends when no two
    are at least `least` near on average; a cluster's name is its smallest point. Points that are never united have no row.
    """
    one = F.lit(1).cast("long")
    state = scratch.write(edges.where(F.col("s") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", one.alias("na"), one.alias("nb")))
    rounds: list[DataFrame] = []
    while True:
        near = state.withColumn("m", F.col("s") / (F.col("na") * F.col("nb"))).where(F.col("m") >= least)
        end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), "m", (F.col("na") + F.col("nb")).alias("n"))
        ends = near.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("e.*")
        best = ends.groupBy("x").agg(F.min_by(F.struct("y", "n"), F.struct(-F.round("m", 12), F.col("y"))).alias("b")).select("x", "b.*")
        mutual = best.alias("p").join(best.alias("r"), F.expr("p.y = r.x AND r.y = p.x")).select(F.col("p.x").alias("id"), F.least("p.x", "p.y").alias("to"), F.col("p.n").alias("n"))
        mutual = scratch.write(mutual)
        if mutual.isEmpty():
            break
        rounds.append(mutual)
        to = lambda c: mutual.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}"), F.col("n").alias(f"n_{c}"))  # noqa: B023, E731
        moved = state.join(to("a"), "a", "left").join(to("b"), "b", "left")
        x, y = (F.struct(F.coalesce(f"to_{c}", c).alias("id"), F.coalesce(f"n_{c}", f"n{c}").alias("n")) for c in "ab")
        moved = moved.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "s").where("x.id != y.id")
        sums = moved.groupBy("x", "y").agg(F.sum("s").alias("s")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "s", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        after = scratch.write(sums)
        scratch.drop(state)
        state = after
    names = mutual.select("id", F.col("to").alias("cluster"))
    while rounds:
        earlier = rounds.pop().select("id", "to")
        higher = earlier.join(names.withColumnRenamed("id", "to"), "to", "left").select("id", F.coalesce("cluster", "to").alias("cluster"))
        names = scratch.write(higher.unionByName(names.join(earlier.select("id"), "id", "left_anti")))
    return names


def link_variants(df: DataFrame, id_col: str = "row_id", string_col: str = "string", group_col: str = "group") -> DataFrame:
    """(id, group): each row without group that names an entity which has a group, and that group's label.

    The average linkage of a name to a group is the mean cosine to the group's rows, rows that share no part with it counting 0;
    that of a cluster of names is the mean of its names'. A name goes to its cluster's best group where it is within the edits
    of a row of the group, or of a name of its cluster that is. Null strings, and strings of which nothing but loose words and
    kinds is left, are linked with nothing; names whose best group is below the thresholds give no row. Ties go to the label
    first by code point. Groups that share a 64-bit hash would fail by name.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(string_col).alias("s"), F.col(group_col).alias("g")).where("s is not null")
    normal = lambda of: once(of, "norm", normal_text("s")).where("norm != ''")
    named = normal(rows.where("g is not null")).select(F.xxhash64("g").alias("gid"), "norm", (F.col("s") == F.col("g")).cast("int").alias("own"))
    forms = scratch.write(named.groupBy("gid", "norm").agg(F.count("*").alias("n"), F.max("own").alias("own")))
    known = learn(forms, scratch)
    held = once(forms, "p", parsed("norm", known)).where("p is not null").groupBy("gid", "p").agg(F.sum("n").alias("n"))
    open_rows = once(normal(rows.where("g is null")), "p", parsed("norm", known)).where("p is not null")
    open_rows = scratch.write(open_rows.select("_id", "p", F.xxhash64("p").alias("q")))
    asked = open_rows.groupBy("p").agg(F.count("*").alias("n")).select(F.lit(None).cast("long").alias("gid"), "p", "n")
    points = held.select("gid", "p", "n").unionByName(asked)
    points = scratch.write(points.select(F.when(F.col("gid").isNull(), F.xxhash64("p")).otherwise(F.xxhash64("gid", "p")).alias("id"), "gid", "p.kind", "p.given", "p.core", "n"))
    scratch.drop(forms)

    near = scratch.write(near_pairs(points, gram_weights(points), scratch))
    of = points.select(F.col("id").alias("f"), "gid", "n")
    near = scratch.write(near.join(of, "f"))
    whole = points.where("gid is not null").groupBy("gid").agg(F.sum("n").alias("rows"))
    direct = near.where("gid is not null").groupBy("q", "gid").agg(F.sum(F.col("n") * F.col("cos")).alias("sum"), F.min("share").alias("share"))
    direct = scratch.write(direct.join(whole, "gid").select("q", "gid", (F.col("sum") / F.col("rows")).alias("link"), "share"))
    # names without a group, among themselves
    own = near.where("gid is null").select(F.least("q", "f").alias("a"), F.greatest("q", "f").alias("b"), F.col("cos").alias("s")).distinct()
    own = scratch.write(own.groupBy("a", "b").agg(F.max("s").alias("s")))
    clusters = scratch.write(average_linkage(own, scratch))
    everyone = open_rows.select("q").distinct().join(clusters.withColumnRenamed("id", "q"), "q", "left").select("q", F.coalesce("cluster", "q").alias("cluster"))
    everyone = scratch.write(everyone)
    size = everyone.groupBy("cluster").agg(F.count("*").alias("size"))
    linked = direct.join(everyone, "q").groupBy("cluster", "gid").agg(F.sum("link").alias("sum"), F.min("share").alias("share")).join(size, "cluster")
    linked = linked.withColumn("link", F.col("sum") / F.col("size")).where(F.col("link") >= FLOOR)
    labels = df.where(F.col(group_col).isNotNull()).select(F.xxhash64(group_col).alias("gid"), F.col(group_col).alias("g")).distinct()
    labels = labels.groupBy("gid").agg(F.min("g").alias("g"), F.max("g").alias("last"))
    clash = F.raise_error(F.concat(F.lit("hashes of groups collide: "), F.col("g"), F.lit(" / "), F.col("last"))).cast("string")
    labels = labels.select("gid", F.when(F.col("g") == F.col("last"), F.col("g")).otherwise(clash).alias("g"))
    best = linked.join(labels, "gid").groupBy("cluster").agg(F.min_by(F.struct("gid", "g"), F.struct(F.round(F.col("share") - F.col("link"), 9), F.col("g"))).alias("b"))
    chosen = scratch.write(everyone.join(best, "cluster").select("q", "cluster", "b.gid", "b.g"))
    sure = scratch.write(chosen.join(direct.select("q", "gid"), ["q", "gid"], "left_semi").select("q", "cluster", "g"))
    tied = own.select(F.explode(F.array(F.struct(F.col("a").alias("q"), F.col("b").alias("o")), F.struct(F.col("b").alias("q"), F.col("a").alias("o")))).alias("e")).select("e.*")
    through = tied.join(sure.select(F.col("q").alias("o"), "cluster"), "o").select("q", "cluster").distinct()
    others = chosen.join(sure.select("q"), "q", "left_anti").join(through, ["q", "cluster"], "left_semi").select("q", "cluster", "g")
    return open_rows.join(sure.unionByName(others).select("q", "g"), "q").select(F.col("_id").alias(id_col), F.col("g").alias("group"))
