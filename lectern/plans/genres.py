"""Genres of books by a taxonomy of keywords: classification, normal names, collection reports, suggestions.

The taxonomy is a parameter (`Taxonomy`); `DEFAULT` has 21 genres. Its keywords make one pattern, each text is read once for
all of them where the book's row is, and only hits become rows: no table of keywords is joined with the books.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import adapters
from lectern.registry import dealt_libraries, register
from lectern.storage import written

# Genres in order, each with its parent, its aliases and its keywords; major genres; fiction and its contrary.
GENRES: list[tuple[str, str | None, list[str], list[str]]] = [
    ("Fiction", None, ["novel", "fiction"], ["novel", "story", "tale"]),
    ("Science Fiction", "Fiction", ["sci-fi", "sf", "scifi"], ["space", "robot", "alien", "future", "dystopia", "technology", "artificial", "mars", "galaxy", "cyberpunk", "android", "spaceship", "interstellar", "quantum"]),
    ("Fantasy", "Fiction", ["fantastical"], ["magic", "wizard", "dragon", "elf", "kingdom", "sword", "quest", "mythical", "prophecy", "enchanted", "sorcerer", "medieval", "realm", "throne"]),
    ("Mystery", "Fiction", ["detective", "whodunit"], ["detective", "murder", "crime", "investigation", "suspect", "clue", "sleuth", "forensic", "alibi", "victim", "witness", "police"]),
    ("Thriller", "Fiction", ["suspense"], ["thriller", "suspense", "chase", "conspiracy", "spy", "assassin", "danger", "escape", "pursuit", "hostage", "terrorist", "agent"]),
    ("Romance", "Fiction", ["love story", "romantic"], ["love", "romance", "heart", "passion", "desire", "relationship", "wedding", "marriage", "couple", "attraction", "soulmate"]),
    ("Horror", "Fiction", ["scary", "terror"], ["horror", "scary", "ghost", "monster", "haunted", "nightmare", "terror", "undead", "vampire", "zombie", "supernatural", "evil", "dark"]),
    ("Literary Fiction", "Fiction", ["literature", "literary"], ["literary", "contemporary", "character", "society", "human condition", "introspective", "prose"]),
    ("Historical Fiction", "Fiction", ["historical novel"], ["war", "century", "historical", "period", "era", "ancient", "medieval", "victorian", "civil war", "world war", "revolutionary"]),
    ("Non-Fiction", None, ["nonfiction", "non fiction"], ["true", "factual", "real"]),
    ("Biography", "Non-Fiction", ["memoir", "autobiography", "life story"], ["biography", "memoir", "life", "autobiography", "personal", "journey", "story of"]),
    ("History", "Non-Fiction", ["historical"], ["history", "historical", "civilization", "empire", "revolution", "ancient", "war", "period"]),
    ("Science", "Non-Fiction", ["scientific"], ["science", "scientific", "physics", "biology", "chemistry", "evolution", "research", "experiment", "theory", "discovery", "nature"]),
    ("Self-Help", "Non-Fiction", ["personal development", "self improvement"], ["self-help", "improve", "success", "habit", "mindset", "productivity", "motivation", "goal", "growth", "wellness", "happiness"]),
    ("Business", "Non-Fiction", ["finance", "economics"], ["business", "management", "leadership", "startup", "entrepreneur", "company", "market", "strategy", "investing", "money", "career"]),
    ("Philosophy", "Non-Fiction", ["philosophical"], ["philosophy", "ethics", "moral", "existence", "consciousness", "meaning", "truth", "wisdom"]),
    ("Psychology", "Non-Fiction", ["psychological"], ["psychology", "mind", "behavior", "cognitive", "mental", "therapy", "brain", "emotion"]),
    ("Young Adult", None, ["YA", "teen"], ["young adult", "teen", "coming of age", "high school", "adolescent"]),
    ("Children's", None, ["kids", "children"], ["children", "kids", "picture book", "fairy tale", "adventure", "animal", "bedtime"]),
    ("Poetry", None, ["poems", "verse"], ["poetry", "poem", "verse", "lyrical", "stanza"]),
    ("Graphic Novel", None, ["comic", "manga"], ["graphic novel", "comic", "manga", "illustrated"]),
]
MAJOR = ["Fiction", "Non-Fiction", "Science Fiction", "Fantasy", "Mystery", "Biography", "History", "Science", "Self-Help"]
FICTION = ["Fiction", "Science Fiction", "Fantasy", "Mystery", "Thriller", "Romance", "Horror", "Literary Fiction", "Historical Fiction", "Young Adult"]
NONFICTION = ["Non-Fiction", "Biography", "History", "Science", "Self-Help", "Business", "Philosophy", "Psychology"]
# What a named genre, a word of an unknown genre, of a subject, of the title and of the description count.
NAMED, GUESSED, SUBJECT, TITLE, DESCRIPTION = 2.0, 1.5, 1.0, 0.5, 0.3
SECONDARY, SECONDARIES, FALLBACK = 0.3, 4, ("Fiction", 0.5)
DOMINANT, DOMINANTS, SAMPLES, SUGGESTED = 0.15, 3, 5, 5


def longest(words: list[str]) -> str:
    """A pattern for the longest of the words that start at a place: their common beginnings are tried once."""
    ends: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        ends.setdefault(w[:1], []).append(w[1:])
    tails = [re.escape(first) + longest(rest) for first, rest in ends.items() if first]
    body = tails[0] if len(tails) == 1 and "" not in ends else f"(?:{'|'.join(tails)})" if tails else ""
    return body + "?" if tails and "" in ends else body


@dataclass(frozen=True)
class Taxonomy:
    """Genres as (name, parent, aliases, keywords), in order."""

    genres: list[tuple[str, str | None, list[str], list[str]]]

    def words(self) -> list[tuple[str, int, int, str]]:
        """(word, place of the word, place of the genre under it, genre): keywords, then aliases, of each genre in turn."""
        order: dict[str, list[str]] = {}
        for name, _, aliases, keywords in self.genres:
            for word in [*keywords, *aliases]:
                order.setdefault(word.lower(), []).append(name)
        return [(word, k, n, genre) for k, (word, genres) in enumerate(order.items()) for n, genre in enumerate(genres)]

    def names(self) -> dict[str, str]:
        """Aliases in lower case and what they stand for; the first genre that has one keeps it."""
        found: dict[str, str] = {}
        for name, _, aliases, _ in self.genres:
            for alias in aliases:
                found.setdefault(alias.lower(), name)
        return found

    def parents(self) -> dict[str, str | None]:
        return {name: parent for name, parent, _, _ in self.genres}

    def hits(self, text: Column) -> Column:
        """Structs (k, n, genre) of the words that the text contains."""
        words = self.words()
        places = {w: k for w, k, _, _ in words}
        pattern = re.compile(f"(?=({longest(list(places))}))")
        inside = {w: [k for v, k in places.items() if w.startswith(v)] for w in places}  # the words that start where w does

        @F.pandas_udf("array<int>")
        def found(low: pd.Series) -> pd.Series:
            return low.map(lambda t: sorted({k for w in set(pattern.findall(t)) for k in inside[w]}), na_action="ignore")

        each = [F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(g).alias("genre")) for v, k, n, g in words if v == w]) for w in places]
        return F.flatten(F.transform(found(F.lower(text)), lambda k: F.get(F.array(*each), k)))

    def normal(self, raw: Column) -> Column:
        """The genre of a name (as it is written) or an alias (in any case); else null."""
        names = F.create_map(*[F.lit(x) for pair in self.names().items() for x in pair])
        return F.when(raw.isin([g[0] for g in self.genres]), raw).otherwise(F.get(F.array(F.element_at(names, F.lower(raw))), F.lit(0)))

    def parent(self, genre: Column) -> Column:
        pairs = [(g, p) for g, p in self.parents().items() if p]
        return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), genre)


DEFAULT = Taxonomy(GENRES)


def classify(books: DataFrame, taxonomy: Taxonomy = DEFAULT, id_col: str = "book_id") -> DataFrame:
    """(id, genre, score, share, place) of every genre of each book; books has title, description, subjects, genres.

    share is the score over the book's greatest; places go by score, then by where a genre was met first: given genres,
    subjects, title, description, in the taxonomy's order of words. A book that meets none has Fiction at 0.5. Nulls
    count as empty; repeated ids are added up as one book.
    """
    def texts(array: Column, start: int, weight: float) -> Column:
        return F.transform(F.coalesce(array, F.expr("cast(array() as array<string>)")), lambda t, i: F.struct((F.lit(start) + i).alias("seq"), t.alias("text"), F.lit(weight).alias("weight"), F.lit(start == 0).alias("named")))

    far = 1_000_000  # later than any list of genres or subjects
    every = F.concat(texts(F.col("genres"), 0, GUESSED), texts(F.col("subjects"), far, SUBJECT), texts(F.array("title"), 2 * far, TITLE), texts(F.array("description"), 3 * far, DESCRIPTION))
    each = books.select(F.col(id_col).alias("_id"), F.explode(F.filter(every, lambda x: x["text"].isNotNull())).alias("t")).select("_id", "t.*")
    normal = taxonomy.normal(F.col("text"))
    known = F.when(F.col("named") & normal.isNotNull(), F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), normal.alias("genre"))))
    weight = F.when(F.col("named") & normal.isNotNull(), NAMED).otherwise(F.col("weight"))
    found = F.coalesce(known, F.transform(taxonomy.hits(F.col("text")), lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"), x["genre"].alias("genre"))))
    rows = each.select("_id", "seq", weight.alias("weight"), F.explode(found).alias("x"))
    scored = rows.groupBy("_id", F.col("x.genre").alias("genre")).agg(F.round(F.sum("weight"), 6).alias("score"), F.min(F.struct("seq", "x.k", "x.n")).alias("first"))
    book = Window.partitionBy("_id")
    placed = scored.select("_id", "genre", "score", (F.col("score") / F.max("score").over(book)).alias("share"), F.row_number().over(book.orderBy(F.desc("score"), "first")).alias("place"))
    all_books = books.select(F.col(id_col).alias("_id")).distinct().join(placed, "_id", "left")
    return all_books.select(F.col("_id").alias(id_col), F.coalesce("genre", F.lit(FALLBACK[0])).alias("genre"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("share", F.lit(FALLBACK[1])).alias("share"), F.coalesce("place", F.lit(1)).alias("place"))


def labels(classified: DataFrame) -> DataFrame:
    """The primary genre of each book and at most four secondary ones."""
    return classified.where((F.col("place") == 1) | ((F.col("place") <= 1 + SECONDARIES) & (F.col("share") > SECONDARY)))


def counted(owned: DataFrame, classified: DataFrame, *more: str) -> DataFrame:
    """(library_id, genre, n, first_book, samples, *more): primary genres of each library; more are columns of classified, of which the greatest counts.

    A group is one run of sorted rows, of which the first takes the samples: no lists are gathered.
    """
    mine = owned.join(classified.where("place = 1").select("book_id", "genre", *more), "book_id")
    rising = Window.partitionBy("library_id", "genre").orderBy("book_id")
    whole = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = [F.lead("book_id", k).over(rising) for k in range(1, SAMPLES)]
    rows = mine.select("library_id", "genre", F.col("book_id").alias("first_book"), F.row_number().over(rising).alias("at"), F.count("*").over(whole).alias("n"), F.array("book_id", *following).alias("some"), *[F.max(c).over(whole).alias(c) for c in more])
    return rows.where("at = 1").select("library_id", "genre", "n", "first_book", F.array_join("some", ",").alias("samples"), *more)


def collection(owned: DataFrame, classified: DataFrame) -> DataFrame:
    """(library_id, genre, n, share_pct, r, dominant, samples, fiction_pct, nonfiction_pct): primary genres of each library.

    owned is (library_id, book_id). Places go by number, then by the least book; samples are the first five books.
    """
    return shares(counted(owned, classified))


def shares(grouped: DataFrame) -> DataFrame:
    """collection() of what counted() gives."""
    library = Window.partitionBy("library_id")

    def side(names: list[str]) -> Column:
        return F.sum(F.when(F.col("genre").isin(names), F.col("n")).otherwise(0)).over(library)

    placed = grouped.select(
        "library_id", "genre", "n", "samples", F.sum("n").over(library).alias("total"), side(FICTION).alias("fiction"), side(NONFICTION).alias("nonfiction"), F.row_number().over(library.orderBy(F.desc("n"), "first_book")).alias("r")
    )
    both = F.col("fiction") + F.col("nonfiction")
    return placed.select(
        "library_id", "genre", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("share_pct"), "r", ((F.col("r") <= DOMINANTS) & (F.col("n") >= DOMINANT * F.col("total"))).alias("dominant"), "samples",
        *[F.when(both > 0, F.round(100 * F.col(name) / both, 6)).otherwise(0.0).alias(f"{name}_pct") for name in ("fiction", "nonfiction")],
    )


def suggest(report: DataFrame, liked: DataFrame, taxonomy: Taxonomy = DEFAULT) -> DataFrame:
    """(library_id, genre, place): major genres that a library lacks and that are related to what it likes, then children of its
    dominant genres that it does not like yet; five at most. report is collection(), liked (library_id, genre)."""
    parents = taxonomy.parents()
    lists = report.groupBy("library_id").agg(F.collect_set("genre").alias("has"), F.array_sort(F.collect_list(F.when(F.col("dominant"), F.struct("r", "genre")))).alias("leads"))
    likes = liked.groupBy("library_id").agg(F.collect_set("genre").alias("likes"))
    rows = lists.join(likes, "library_id", "left").withColumn("likes", F.coalesce("likes", F.expr("cast(array() as array<string>)")))
    options = F.array(*[F.struct(F.lit(g).alias("genre"), F.lit(list(related(g, parents))).alias("kin")) for g in MAJOR])
    missing = F.transform(F.filter(options, lambda o: ~F.array_contains(F.col("has"), o["genre"]) & F.arrays_overlap(o["kin"], F.col("likes"))), lambda o: o["genre"])
    children = F.create_map(*[x for p in dict.fromkeys(p for p in parents.values() if p) for x in (F.lit(p), F.array(*[F.lit(g) for g, q in parents.items() if q == p]))])
    below = F.flatten(F.transform("leads", lambda d: F.coalesce(F.element_at(children, d["genre"]), F.expr("cast(array() as array<string>)"))))
    new = F.filter(below, lambda g: ~F.array_contains(F.col("likes"), g))
    return rows.select("library_id", F.posexplode(F.slice(F.concat(missing, new), 1, SUGGESTED)).alias("at", "genre")).select("library_id", "genre", (F.col("at") + 1).alias("place"))


def related(genre: str, parents: dict[str, str | None]) -> list[str]:
    """Genres of the taxonomy that, when liked, speak for this one: of the same parent (or of none, like it), or its parent."""
    return [g for g, p in parents.items() if p == parents[genre] or parents[genre] == g]


# -- queries: books with a second, free-hand list of genre names, and documents of the same number as descriptions

_RAW = ["Sci-Fi", "YA", "novel", "Fantasy", "fantasy", "memoir", "Nonfiction", "dark magic", "war stories", "SF", "Mystery", "kids", "true crime", "poems", "History", "historical", "odd"]
_SHELF = "select b.book_id, title, d.text as description, b.genres as subjects, library_raw as genres from (select b.*, {raw} as library_raw from books b) b left join documents d on d.doc_id = b.book_id"


def _picked(index: str, one_based: bool) -> str:
    return f"split('{'|'.join(_RAW)}', '{'[|]' if not one_based else '|'}')[({index}) % {len(_RAW)}{' + 1' if one_based else ''}]"


def _raw(one_based: bool) -> str:
    picks = [_picked(i, one_based) for i in ("book_id * 5", "book_id * 7 + 3")]
    return f"case when book_id % 4 = 3 then {'[]::varchar[]' if one_based else 'cast(array() as array<string>)'} else {'[' if one_based else 'array('}{', '.join(picks)}{']' if one_based else ')'} end"


def _books(s: SparkSession, d: str) -> DataFrame:
    return adapters.query(s, d, ["books"], _SHELF.format(raw=_raw(False)))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows)


def _quoted(names: list[str]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


_CLASSIFIED_ORACLE = f"""shelf as ({_SHELF.format(raw=_raw(True))}), kw(w, k, n, genre) as (values {_values(DEFAULT.words())}), named(alias, genre) as (values {_values(list(DEFAULT.names().items()))}),
    tree(genre, parent, ord) as (values {_values([(g, p, i) for i, (g, p) in enumerate(DEFAULT.parents().items())])}),
    texts as (select book_id, i as seq, genres[i] as text, {GUESSED}::double as weight, true as given from shelf, unnest(range(1, len(genres) + 1)) u(i)
      union all select book_id, 1000000 + i, subjects[i], {SUBJECT}, false from shelf, unnest(range(1, len(subjects) + 1)) u(i) union all select book_id, 2000000, title, {TITLE}, false from shelf union all select book_id, 3000000, description, {DESCRIPTION}, false from shelf),
    told as (select t.*, coalesce(x.genre, a.genre) as normal from texts t left join tree x on x.genre = t.text left join named a on a.alias = lower(t.text)),
    hits as (select book_id, seq, 0 as k, 0 as n, normal as genre, {NAMED}::double as weight from told where given and normal is not null
      union all select t.book_id, t.seq, kw.k, kw.n, kw.genre, t.weight from told t join kw on contains(lower(t.text), kw.w) where not (given and normal is not null)),
    scored as (select book_id, genre, round(sum(weight), 6) as score, min({{'seq': seq, 'k': k, 'n': n}}) as first from hits group by book_id, genre),
    placed as (select *, score / max(score) over (partition by book_id) as share, row_number() over (partition by book_id order by score desc, first) as place from scored),
    classified as (select s.book_id, coalesce(p.genre, 'Fiction') as genre, coalesce(p.share, 0.5) as share, coalesce(p.place, 1) as place from shelf s left join placed p on p.book_id = s.book_id)"""
_REPORT_ORACLE = f"""{_CLASSIFIED_ORACLE}, mine as (select l.library_id, l.book_id, c.genre, row_number() over (partition by l.library_id, c.genre order by l.book_id) as pos from libraries l join classified c on c.book_id = l.book_id and c.place = 1),
    counted as (select library_id, genre, count(*) as n, min(book_id) as first_book, string_agg(book_id, ',' order by book_id) filter (pos <= {SAMPLES}) as samples from mine group by library_id, genre),
    shares as (select *, sum(n) over (partition by library_id) as total, row_number() over (partition by library_id order by n desc, first_book) as r,
                      sum(case when genre in ({_quoted(FICTION)}) then n else 0 end) over (partition by library_id) as f, sum(case when genre in ({_quoted(NONFICTION)}) then n else 0 end) over (partition by library_id) as nf from counted),
    report as (select library_id, genre, n, round(100 * n / total, 6) as share_pct, r, r <= {DOMINANTS} and n >= {DOMINANT} * total as dominant, samples,
                      case when f + nf > 0 then round(100 * f / (f + nf), 6) else 0 end as fiction_pct, case when f + nf > 0 then round(100 * nf / (f + nf), 6) else 0 end as nonfiction_pct from shares)"""
_LIKED = "select distinct l.library_id, c.genre from libraries l join books b on b.book_id = l.book_id and b.rating >= 4 join classified c on c.book_id = l.book_id and c.place = 1"


def _report(s: SparkSession, d: str) -> DataFrame:
    return collection(dealt_libraries(s, d), classify(_books(s, d)))


def _suggested(s: SparkSession, d: str) -> DataFrame:
    """What a library likes are genres of its books of four stars or more, so it is seen where the genres are counted."""
    stars = adapters.query(s, d, ["books"], "select book_id, max(rating) >= 4 as liked from books group by book_id")
    grouped = written(counted(dealt_libraries(s, d), classify(_books(s, d)).where("place = 1").join(stars, "book_id"), "liked"), "genres")
    return suggest(shares(grouped), grouped.where("liked").select("library_id", "genre"))


register("genre_classify", lambda s, d: labels(classify(_books(s, d))).select("book_id", "genre", F.round("share", 6).alias("share"), "place"), ["books"], f"with {_CLASSIFIED_ORACLE} select book_id, genre, round(share, 6) as share, place from classified where place = 1 or (place <= 5 and share > 0.3)")
register("genre_normalize", lambda s, d: _books(s, d).select("book_id", F.explode("genres").alias("raw")).withColumn("genre", DEFAULT.normal(F.col("raw"))).withColumn("parent", DEFAULT.parent(F.col("genre"))), ["books"], f"with {_CLASSIFIED_ORACLE} select t.book_id, t.text as raw, t.normal as genre, x.parent from told t left join tree x on x.genre = t.normal where t.given")
register("genre_collection_report", _report, ["books", "libraries"], f"with {_REPORT_ORACLE} select * from report")
register(
    "suggest_genres", _suggested, ["books", "libraries"],
    f"""with {_REPORT_ORACLE}, liked as ({_LIKED}), major(genre, ord) as (values {_values([(g, i) for i, g in enumerate(MAJOR)])}), libs as (select distinct library_id from report),
        lacking as (select l.library_id, m.genre, m.ord from libs l cross join major m where not exists (select 1 from report r where r.library_id = l.library_id and r.genre = m.genre)),
        wanted as (select k.library_id, 0 as part, k.ord as o, 0 as o2, k.genre from lacking k join tree t on t.genre = k.genre where exists (select 1 from liked a join tree x on x.genre = a.genre where a.library_id = k.library_id and (x.parent is not distinct from t.parent or t.parent = a.genre))),
        below as (select r.library_id, 1 as part, r.r as o, t.ord as o2, t.genre from report r join tree t on t.parent = r.genre where r.dominant and not exists (select 1 from liked a where a.library_id = r.library_id and a.genre = t.genre)),
        chosen as (select library_id, genre, row_number() over (partition by library_id order by part, o, o2) as place from (select * from wanted union all select * from below))
        select * from chosen where place <= {SUGGESTED}""",
)
