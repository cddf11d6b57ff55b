"""Diversity, genre and recommendation analytics per library, and matching scores."""

from pyspark.sql import DataFrame, SparkSession

from lectern import adapters
from lectern.plans.books import MAJOR, MINOR
from lectern.plans.text import register_edits
from lectern.registry import dialect, register, register_by_library, register_dialects, register_sql

_COUNTS = "g as (select library_id, $EXPLODE(genres) as genre from owned), c as (select library_id, genre, count(*) as n from g group by library_id, genre), t as (select library_id, genre, n, cast(n as double) / sum(n) over (partition by library_id) as p, count(*) over (partition by library_id) as u from c)"
_GENRE = "genre_part as (select library_id, max(u) as genres, -sum(p * log2(p)) as entropy, case when max(u) > 1 then -sum(p * log2(p)) / log2(max(u)) else 0e0 end as evenness from t group by library_id)"
_AUTHOR = "a as (select library_id, author, count(*) as n from owned group by library_id, author), au as (select *, sum(n) over (partition by library_id) as total, count(*) over (partition by library_id) as u from a), author_part as (select library_id, max(u) as authors, cast(max(total) as bigint) as books, cast(max(u) as double) / max(total) as ratio, 1 - sum(power(cast(n as double) / total, 2)) as gini from au group by library_id)"
_YEARS = "year_part as (select library_id, max(publication_year) - min(publication_year) as spread, coalesce(stddev_pop(publication_year), 0e0) as sd, count(distinct floor(publication_year / 10)) as decades from owned where publication_year is not null group by library_id)"

register_by_library("shannon_diversity", f"with {_COUNTS}, {_GENRE} select library_id, genres, $ROUND(entropy, $SIX) as entropy, $ROUND(evenness, $SIX) as evenness, $ROUND(0.8e0 * evenness + 0.2e0 * least(genres / 12e0, 1e0), $SIX) as score from genre_part")
register_dialects("author_diversity", ["owned"], f"with {_AUTHOR} select library_id, authors, $ROUND(gini, $SIX) as gini, $ROUND(0.7e0 * (0.6e0 * ratio + 0.4e0 * gini) + 0.3e0 * least(ratio / 0.7e0, 1e0), $SIX) as score from author_part")
register_dialects("temporal_diversity", ["owned"], f"with {_YEARS} select library_id, spread, decades, $ROUND(0.4e0 * least(spread / 100e0, 1e0) + 0.3e0 * least(sd / 30e0, 1e0) + 0.3e0 * decades / 15e0, $SIX) as score from year_part")
_SCORES = f"{_COUNTS}, {_GENRE}, {_AUTHOR}, {_YEARS}, scores as (select g.library_id, 0.8e0 * g.evenness + 0.2e0 * least(g.genres / 12e0, 1e0) as genre_score, 0.7e0 * (0.6e0 * a.ratio + 0.4e0 * a.gini) + 0.3e0 * least(a.ratio / 0.7e0, 1e0) as author_score, 0.4e0 * least(y.spread / 100e0, 1e0) + 0.3e0 * least(y.sd / 30e0, 1e0) + 0.3e0 * y.decades / 15e0 as time_score, a.books from genre_part g join author_part a on a.library_id = g.library_id join year_part y on y.library_id = g.library_id)"
register_by_library(
    "diversity_report",
    f"""with {_SCORES}, o as (select *, $ROUND(0.35e0 * genre_score + 0.35e0 * author_score + 0.3e0 * time_score, $SIX) as overall from scores)
        select library_id, books, $ROUND(genre_score, $SIX) as genre_score, $ROUND(author_score, $SIX) as author_score, $ROUND(time_score, $SIX) as time_score, overall,
          case when overall >= 0.9 then 'A+' when overall >= 0.85 then 'A' when overall >= 0.8 then 'A-' when overall >= 0.75 then 'B+' when overall >= 0.7 then 'B' when overall >= 0.65 then 'B-' when overall >= 0.6 then 'C+' when overall >= 0.55 then 'C' when overall >= 0.5 then 'C-' when overall >= 0.4 then 'D' else 'F' end as grade,
          concat_ws('; ', case when genre_score < 0.7 then 'read more genres' end, case when author_score < 0.9 then 'try new authors' end, case when time_score < 0.8 then 'visit other decades' end) as advice from o""",
)
register_by_library("diversity_stats_simple", f"with {_SCORES.replace('a.books from', 'a.books, a.authors, g.entropy, y.sd from')} select library_id, $ROUND(0.3e0 * least(1e0, authors / (0.8e0 * books)) + 0.4e0 * least(1e0, entropy / 3e0) + 0.3e0 * least(1e0, sd / 30e0), $SIX) as overall from scores")
register_by_library("quick_diversity", f"with {_SCORES.replace('a.books from', 'a.books, g.evenness, a.gini from')} select library_id, $ROUND((evenness + gini) / 2e0, $SIX) as score from scores")
register_by_library("udaf_entropy", f"with {_COUNTS} select library_id, $ROUND(-sum(p * log2(p)), $SIX) as entropy, $ROUND(1 - sum(p * p), $SIX) as gini_simpson from t group by library_id")
# Books that everyone knows, for what the catalog lacks, and genres that lead on from one that a library holds most of. The
# genres stand for science fiction, fantasy, mystery, romance, literary fiction, biography, history and science, in this order.
CLASSICS = {
    "ring": ["Dune by Frank Herbert", "1984 by George Orwell", "Foundation by Isaac Asimov"],
    "bolt": ["The Lord of the Rings by J.R.R. Tolkien", "A Wizard of Earthsea by Ursula K. Le Guin"],
    "gear": ["The Maltese Falcon by Dashiell Hammett", "Murder on the Orient Express by Agatha Christie"],
    "plate": ["To Kill a Mockingbird by Harper Lee", "The Great Gatsby by F. Scott Fitzgerald"],
}
BRIDGES = {
    "ring": ["bolt", "thriller", "popular science"], "bolt": ["ring", "historical fiction", "mythology"], "gear": ["thriller", "crime fiction", "spy novels"], "gizmo": ["contemporary fiction", "historical fiction"],
    "plate": ["classics", "short stories", "memoir"], "widget": ["rod", "historical fiction", "politics"], "anvil": ["philosophy", "technology", "nature"], "rod": ["memoir", "widget", "journalism"],
}
OFFERED = 5
_CLASSICS = "classics(genre, k, size, classic) as (select * from (values " + ", ".join(f"('{g}', {k}, {len(found)}, '{c}')" for g, found in CLASSICS.items() for k, c in enumerate(found)) + ") v(genre, k, size, classic))"
_CLASSICS_OF = "coalesce(try_element_at(map(" + ", ".join(f"'{g}', array({', '.join(map(repr, found))})" for g, found in CLASSICS.items()) + "), {g}), array())"
# the best of each source, author or genre are ranked once: five more than any library owns are enough for all of them
_UNOWNED = "not exists (select 1 from libraries z where z.library_id = {l} and z.book_id = {b})"
_MOST = "most as (select max(c) as m from (select count(*) as c from libraries group by library_id) q)"
_SOURCE = "source as (select library_id, min(book_id) as source_id from owned group by library_id)"


def _register_ranked(key: str, body: str, spark: str | None = None) -> None:
    """A query whose ranks stop a few places after the largest library: that number is looked up first, so that Spark drops
    later ranks in each task before it shuffles. spark is the text for Spark where it goes another way than DuckDB."""

    def build(session: SparkSession, sf_dir: str) -> DataFrame:
        most = adapters.query(session, sf_dir, ["libraries"], "select coalesce(max(c), 0) as m from (select count(*) as c from libraries group by library_id) q").first()[0]
        text = (spark or body).replace(f"{_MOST}, ", "").replace(" cross join most where r <= m +", f" where r <= {most} +").replace("$MOST", str(most))
        return adapters.query(session, sf_dir, ["owned"], dialect(text, 0))

    register(key, build, ["owned"], dialect(body, 1))


# For Spark: what is offered to many libraries is a list, in order and as long as above, and a library takes the first books of it that
# it lacks; so neither lists nor the pairs of library and book are dealt out row by row.
_HELD = "held as (select library_id, collect_list(book_id) as ids from libraries group by library_id)"

#: Books by genre set, for Spark: few sets stand for all books, so sets are compared, and each gives its first books only.
_SETS = f"""{_SOURCE}, live as (select book_id, array_sort(array_distinct(genres)) as gset from books where not is_deleted),
        sets as (select gset, count(*) as n from live group by gset), origin as (select s.library_id, array_sort(array_distinct(b.genres)) as wset from source s join books b on b.book_id = s.source_id),
        wg as (select wset, explode(wset) as genre from (select distinct wset from origin) o), sg as (select gset, n, explode(gset) as genre from sets),
        pairs as (select wset, gset, n, count(*) as overlap from wg join sg on sg.genre = wg.genre group by wset, gset, n),
        levels as (select wset, overlap, sum(sum(n)) over (partition by wset order by overlap desc) - sum(n) as before from pairs group by wset, overlap),
        heads as (select gset, book_id from (select gset, book_id, row_number() over (partition by gset order by book_id) as q from live) q where q <= $MOST + 5),
        ranked as (select p.wset, h.book_id, p.overlap, row_number() over (partition by p.wset order by p.overlap desc, h.book_id) as r
                   from pairs p join levels l on l.wset = p.wset and l.overlap = p.overlap and l.before < $MOST + 5 join heads h on h.gset = p.gset),
        offers as (select wset, transform(array_sort(collect_list(struct(r, book_id, overlap))), x -> struct(x.book_id, x.overlap)) as offered from ranked where r <= $MOST + 5 group by wset),
        near as (select o.library_id, posexplode(slice(filter(slice(f.offered, 1, size(h.ids) + 5), x -> not array_contains(h.ids, x.book_id)), 1, 5)) as (pos, x) from origin o join held h on h.library_id = o.library_id join offers f on f.wset = o.wset),
        by_similar as (select library_id, x.book_id, x.overlap, pos + 1 as place from near)"""
_register_ranked(
    "recommend_similar",
    f"""with {_SOURCE}, {_MOST}, gs as (select s.source_id, $EXPLODE($DISTINCT(b.genres)) as genre from (select distinct source_id from source) s join books b on b.book_id = s.source_id), gb as (select book_id, $EXPLODE($DISTINCT(genres)) as genre from books where not is_deleted),
        found as (select gs.source_id, gb.book_id, count(*) as overlap from gs join gb on gb.genre = gs.genre group by gs.source_id, gb.book_id),
        ranked as (select *, row_number() over (partition by source_id order by overlap desc, book_id) as r from found), best as (select source_id, book_id, overlap from ranked cross join most where r <= m + 5),
        placed as (select s.library_id, f.book_id, f.overlap, row_number() over (partition by s.library_id order by f.overlap desc, f.book_id) as place from source s join best f on f.source_id = s.source_id where {_UNOWNED.format(l='s.library_id', b='f.book_id')})
        select library_id, book_id, overlap, round(least(0.5e0 + 0.15e0 * overlap, 0.95e0), 6) as confidence, place from placed where place <= 5""",
    f"with {_HELD}, {_SETS} select library_id, book_id, overlap, round(least(0.5e0 + 0.15e0 * overlap, 0.95e0), 6) as confidence, place from by_similar where place <= 5",
)
_AUTHORS = f"liked as (select library_id, author, count(*) as n from owned group by library_id, author having count(*) >= 2), {_MOST}, by_name as (select lower(author) as name, author, book_id, row_number() over (partition by lower(author) order by book_id) as r from books where not is_deleted), first_books as (select name, author, book_id from by_name cross join most where r <= m + 2)"
_BY_AUTHOR = f"by_author as (select k.library_id, b.book_id, b.author, k.n, row_number() over (partition by k.library_id order by k.n desc, b.book_id) as place from liked k join first_books b on b.name = lower(k.author) where {_UNOWNED.format(l='k.library_id', b='b.book_id')})"
_AUTHOR_LISTS = """by_name as (select lower(author) as name, author, book_id, row_number() over (partition by lower(author) order by book_id) as r from books where not is_deleted),
        firsts_of as (select name, array_sort(collect_list(struct(book_id, author))) as firsts from by_name where r <= $MOST + 2 group by name),
        same_name as (select library_id, lower(author) as name, collect_list(author) as authors, collect_list(book_id) as ids from owned group by library_id, lower(author) having count(*) >= 2),
        lacking as (select s.library_id, s.authors, slice(filter(slice(f.firsts, 1, size(s.ids) + 2), x -> not array_contains(s.ids, x.book_id)), 1, 2) as lacked from same_name s join firsts_of f on f.name = s.name),
        liked as (select library_id, lacked, explode(filter(transform(array_distinct(authors), a -> size(filter(authors, b -> b = a))), c -> c >= 2)) as n from lacking),
        unheld as (select library_id, n, explode(lacked) as x from liked),
        by_author as (select library_id, x.book_id, x.author, n, row_number() over (partition by library_id order by n desc, x.book_id) as place from unheld)"""
_OFFER_AUTHOR = "select library_id, book_id, author, round(least(0.6e0 + 0.1e0 * n, 0.9e0), 6) as confidence, place from by_author where place <= 2"
_register_ranked("recommend_author", f"with {_AUTHORS}, {_BY_AUTHOR} {_OFFER_AUTHOR}", f"with {_AUTHOR_LISTS} {_OFFER_AUTHOR}")
_GENRES_OF = "gg as (select library_id, $EXPLODE(genres) as genre from owned), gc as (select library_id, genre, count(*) as n from gg group by library_id, genre)"
_TOPGENRE = f"{_GENRES_OF}, best as (select * from (select *, row_number() over (partition by library_id order by n desc, genre) as r from gc) q where r = 1)"
_CATALOG = "catalog as (select book_id, rating, $EXPLODE($DISTINCT(genres)) as genre from books where not is_deleted), by_genre_all as (select genre, book_id, rating, row_number() over (partition by genre order by rating desc, book_id) as r from catalog), top_books as (select genre, book_id, rating from by_genre_all cross join most where r <= m + 5)"
_BY_GENRE = f"by_genre as (select t.library_id, b.book_id, t.genre, row_number() over (partition by t.library_id order by b.rating desc, b.book_id) as place from best t join top_books b on b.genre = t.genre where {_UNOWNED.format(l='t.library_id', b='b.book_id')})"
_GENRE_LISTS = f"""{_CATALOG}, genre_heads as (select genre, transform(array_sort(collect_list(struct(r, book_id))), x -> x.book_id) as heads from top_books_r group by genre),
        genre_found as (select t.library_id, t.genre, posexplode(slice(array_except(g.heads, h.ids), 1, 5)) as (pos, book_id) from best t join held h on h.library_id = t.library_id join genre_heads g on g.genre = t.genre),
        by_genre as (select library_id, genre, book_id, pos + 1 as place from genre_found)""".replace("top_books as (select genre, book_id, rating from", "top_books_r as (select genre, book_id, r from")
_OFFER_GENRE = f"""offered as (select library_id, book_id, genre, place from by_genre where place <= {OFFERED}), filled as (select t.library_id, t.genre, count(o.book_id) as n from best t left join offered o on o.library_id = t.library_id group by t.library_id, t.genre)
        select library_id, book_id, cast(null as varchar(200)) as classic, genre, 0.7e0 as confidence, place from offered
        union all select f.library_id, null, c.classic, f.genre, 0.85e0, f.n + c.k + 1 from filled f join classics c on c.genre = f.genre where f.n + c.k + 1 <= {OFFERED}"""
_GENRE_ROWS = f"""found as (select t.library_id, t.genre, array_except(g.heads, h.ids) as lacked from best t join held h on h.library_id = t.library_id join genre_heads g on g.genre = t.genre),
        offers as (select library_id, genre, posexplode(slice(concat(transform(slice(lacked, 1, {OFFERED}), x -> struct(x as book_id, cast(null as string) as classic, 0.7e0 as confidence)),
          transform({_CLASSICS_OF.format(g='genre')}, c -> struct(cast(null as bigint) as book_id, c as classic, 0.85e0 as confidence))), 1, {OFFERED})) as (pos, x) from found)
        select library_id, x.book_id, x.classic, genre, x.confidence, pos + 1 as place from offers"""
_register_ranked("recommend_genre", f"with {_TOPGENRE}, {_MOST}, {_CATALOG}, {_BY_GENRE}, {_CLASSICS}, {_OFFER_GENRE}", f"with {_HELD}, {_TOPGENRE}, {_GENRE_LISTS[: _GENRE_LISTS.index('genre_found as')]}{_GENRE_ROWS}")
_EXPLORE = f"rare as (select * from (select *, row_number() over (partition by library_id order by n, genre) as r from gc) q where r <= 3), odd as (select genre, book_id, row_number() over (partition by genre order by (book_id * 7919) % 10007, book_id) as r from catalog), odd_books as (select genre, book_id, r from odd cross join most where r <= m + 1), by_rare as (select t.library_id, t.genre, b.book_id, row_number() over (partition by t.library_id, t.genre order by b.r) as place from rare t join odd_books b on b.genre = t.genre where {_UNOWNED.format(l='t.library_id', b='b.book_id')})"
_EXPLORE_LISTS = f"""{_EXPLORE[: _EXPLORE.index('odd_books as')]}odd_heads as (select genre, transform(array_sort(collect_list(struct(r, book_id))), x -> x.book_id) as heads from odd where r <= $MOST + 1 group by genre),
        by_rare as (select * from (select t.library_id, t.genre, get(array_except(o.heads, h.ids), 0) as book_id, 1 as place from rare t join held h on h.library_id = t.library_id join odd_heads o on o.genre = t.genre) q where book_id is not null)"""
_LIBRARY_OF = "totals as (select library_id, sum(n) as total from gc group by library_id)"
_UNDER = f"""{_LIBRARY_OF}, major(ord, genre) as (select * from (values {', '.join(f"({k}, '{g}')" for k, g in enumerate(MAJOR))}) v(ord, genre)),
        rare as (select t.library_id, m.ord, m.genre from totals t cross join major m left join gc on gc.library_id = t.library_id and gc.genre = m.genre where coalesce(gc.n, 0) * {MINOR} < t.total)"""
_OFFER_RARE = f"""bridges(top, ord, genre) as (select * from (values {', '.join(f"('{g}', {k}, '{b}')" for g, found in BRIDGES.items() for k, b in enumerate(found))}) v(top, ord, genre)),
        tried as (select r.library_id, r.ord, r.genre, b.book_id from rare r left join by_rare b on b.library_id = r.library_id and b.genre = r.genre and b.place = 1),
        chosen as (select library_id, 1 as tier, ord, genre, book_id, cast(null as varchar(200)) as classic, 0.5e0 as confidence from tried where book_id is not null
          union all select t.library_id, 1, t.ord, t.genre, null, c.classic, 0.6e0 from tried t join classics c on c.genre = t.genre and c.k = t.library_id % c.size where t.book_id is null
          union all select t.library_id, 2, b.ord, b.genre, null, c.classic, 0.55e0 from best t join bridges b on b.top = t.genre join classics c on c.genre = b.genre and c.k = t.library_id % c.size)
        select library_id, genre, book_id, classic, confidence, row_number() over (partition by library_id order by tier, ord) as place from chosen"""
_RARE_OF = ", ".join(f"case when coalesce(max(case when genre = '{g}' then n end), 0) * {MINOR} < sum(n) then struct(1 as tier, {k} as ord, '{g}' as genre) end" for k, g in enumerate(MAJOR))
_BRIDGES_OF = "map(" + ", ".join(f"'{g}', array({', '.join(f'struct(2 as tier, {k} as ord, {b!r} as genre)' for k, b in enumerate(found))})" for g, found in BRIDGES.items()) + ")"
_RARE_ROWS = f"""odd_heads as (select genre, transform(array_sort(collect_list(struct(r, book_id))), x -> x.book_id) as heads from odd where r <= $MOST + 1 group by genre),
        wanted as (select library_id, array_compact(array({_RARE_OF})) as rares, min_by(genre, struct(-n, genre)) as top from gc group by library_id),
        options as (select w.library_id, h.ids, explode(concat(rares, coalesce(try_element_at({_BRIDGES_OF}, top), array()))) as x from wanted w join held h on h.library_id = w.library_id),
        tried as (select /*+ BROADCAST(o) */ t.library_id, x.tier, x.ord, x.genre, get(array_except(o.heads, t.ids), 0) as book_id, {_CLASSICS_OF.format(g='x.genre')} as known from options t left join odd_heads o on o.genre = x.genre and x.tier = 1),
        chosen as (select library_id, tier, ord, genre, book_id, case when book_id is null then get(known, cast(library_id % greatest(size(known), 1) as int)) end as classic, case when book_id is not null then 0.5e0 when tier = 1 then 0.6e0 else 0.55e0 end as confidence from tried)
        select library_id, genre, book_id, classic, confidence, row_number() over (partition by library_id order by tier, ord) as place from chosen where book_id is not null or classic is not null"""
_ODD = _EXPLORE[_EXPLORE.index("odd as (") :]
_register_ranked(
    "recommend_explore", f"with {_TOPGENRE}, {_MOST}, {_CATALOG}, {_UNDER}, {_ODD}, {_CLASSICS}, {_OFFER_RARE}",
    f"with {_HELD}, {_GENRES_OF}, {_CATALOG[: _CATALOG.index(', by_genre_all as')]}, {_ODD[: _ODD.index('odd_books as')]}{_RARE_ROWS}",
)
_SIMILAR = f"{_SOURCE}, gs as (select s.source_id, $EXPLODE($DISTINCT(b.genres)) as genre from (select distinct source_id from source) s join books b on b.book_id = s.source_id), shared as (select gs.source_id, c.book_id, count(*) as overlap from gs join catalog c on c.genre = gs.genre group by gs.source_id, c.book_id), alike as (select *, row_number() over (partition by source_id order by overlap desc, book_id) as r from shared), alike_books as (select source_id, book_id, overlap from alike cross join most where r <= m + 3), by_similar as (select s.library_id, f.book_id, f.overlap, row_number() over (partition by s.library_id order by f.overlap desc, f.book_id) as place from source s join alike_books f on f.source_id = s.source_id where {_UNOWNED.format(l='s.library_id', b='f.book_id')})"
_MIX = f"""pool as (select library_id, book_id, 1 as strategy, 0.5e0 as confidence, cast(row_number() over (partition by library_id order by genre) as int) as place from by_rare where place = 1
                 union all select library_id, book_id, 2, least(0.5e0 + 0.15e0 * overlap, 0.95e0), cast(place as int) from by_similar where place <= 3
                 union all select library_id, book_id, 3, least(0.6e0 + 0.1e0 * n, 0.9e0), cast(place as int) from by_author where place <= 2
                 union all select library_id, book_id, 4, 0.7e0, cast(place as int) from by_genre where place <= 5),
        quota as (select * from pool where strategy > 1 or place <= 1), firsts as (select *, row_number() over (partition by library_id, book_id order by strategy, place) as copy from quota),
        sorted as (select library_id, book_id, strategy, round(confidence, 6) as confidence, row_number() over (partition by library_id order by round(confidence, 6) desc, strategy, book_id) as place from firsts where copy = 1)
        select * from sorted where place <= 5"""
_register_ranked("recommend_mix", f"with {_AUTHORS}, {_TOPGENRE}, {_CATALOG}, {_BY_AUTHOR}, {_BY_GENRE}, {_EXPLORE}, {_SIMILAR}, {_MIX}", f"with {_HELD}, {_AUTHOR_LISTS}, {_TOPGENRE}, {_GENRE_LISTS}, {_EXPLORE_LISTS}, {_SETS}, {_MIX}")
register_dialects("quick_recommend", ["books"], "with asked(pos, genre) as (select * from (values (1, 'anvil'), (2, 'gear')) v(pos, genre)), g as (select book_id, title, rating, $EXPLODE($DISTINCT(genres)) as genre from books where not is_deleted), head as (select a.pos, a.genre, g.book_id, g.title, g.rating from asked a join g on g.genre = a.genre order by a.pos, g.rating desc, g.book_id limit 8) select pos, genre, book_id, title, row_number() over (order by pos, rating desc, book_id) as place from head")
register_dialects("genre_drilldown", ["books"], "with g as (select book_id, author, publication_year, $EXPLODE($DISTINCT(genres)) as genre from books where not is_deleted) select genre, count(*) as books, count(distinct author) as authors, count(case when publication_year < 1950 then 1 end) as early, count(case when publication_year >= 1950 then 1 end) as late from g group by genre")
register_sql("author_drilldown", ["books"], "select author, count(*) as books, round(avg(rating), 6) as mean_rating, min(publication_year) as first_year, max(publication_year) as last_year from books where not is_deleted group by author")
register_sql("era_pace", ["owned"], "select library_id, cast(floor(publication_year / 10) * 10 as int) as decade, count(*) as books, round(avg(page_count), 6) as pages from owned group by library_id, cast(floor(publication_year / 10) * 10 as int)")

# -- matching scores
_W = "case when confidence > 0.8 then 0.8e0 when confidence < 0.4 then 0.3e0 else 0.3e0 + (confidence - 0.4e0) / 0.4e0 * 0.5e0 end"
register_sql("fusion_weights", ["ocr_pairs"], f"select sample_id, round(least(1e0, greatest(0e0, ({_W}) * case when sample_id % 3 = 0 then 0.9e0 when sample_id % 3 = 1 then 0.95e0 else 1e0 end)), 6) as text_weight from ocr_pairs")
register_sql("modality_quality", ["ocr_pairs"], "select sample_id, round(confidence * case when length(truth) >= 80 then 0.9e0 else 1e0 end * case when length(truth) < 10 then 0.7e0 else 1e0 end, 6) as text_quality, case when confidence >= 0.5 then 'text' else 'visual' end as dominant from ocr_pairs")
register_sql("fusion_confidence", ["ocr_pairs"], "select sample_id, round(case when sample_id % 4 = 0 then least(confidence, 0.7e0) else confidence * (0.8e0 + 0.2e0 * (1 - abs(confidence - 0.5e0))) end, 6) as score from ocr_pairs")
register_edits("confidence_calibrate", ["ocr_pairs"], "with s as (select sample_id, confidence as e, 1 - cast(levenshtein(truth, prediction) as double) / greatest(1, length(truth)) as t from ocr_pairs), c as (select sample_id, least(1e0, greatest(0e0, (0.5e0 * e + 0.5e0 * t) * case when e > 0.8 and t > 0.8 then 1.1e0 when abs(e - t) > 0.3 then 0.9e0 else 1e0 end)) as v from s) select sample_id, round(v, 6) as score, case when v >= 0.85 then 'high' when v >= 0.65 then 'medium' when v >= 0.45 then 'low' else 'very_low' end as label from c")
register_sql("enrich_batch", ["isbn_books", "books"], "with cache as (select isbn_13, book_id, case when book_id % 2 = 0 then 5 else 50 end as age_days from isbn_books where isbn_13 is not null and book_id % 3 = 1), asked as (select book_id, isbn_13 from isbn_books where isbn_13 is not null) select a.book_id, a.isbn_13, case when c.isbn_13 is not null then 'cache' else 'source' end as origin, b.title from asked a left join cache c on c.isbn_13 = a.isbn_13 and c.age_days <= 30 join books b on b.book_id = a.book_id")
