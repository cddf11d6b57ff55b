"""Joins, merges, deduplication, upserts and window reports over the book views."""

from lectern.registry import by_library, dialect, over_bought, register, register_by_library, register_dialects, register_sql

register_sql("enrich_join", ["books", "libraries"], "select l.library_id, l.book_id, b.title, b.author, b.publication_year from libraries l join books b on b.book_id = l.book_id where not b.is_deleted")



def _check13(x: str) -> str:
    """Check digit of the first twelve characters of x."""
    total = " + ".join(f"{1 if i % 2 else 3} * cast(substring({x}, {i}, 1) as int)" for i in range(1, 13))
    return f"cast((10 - ({total}) % 10) % 10 as varchar(1))"


register_sql(
    "isbn_match", ["isbn_books"],
    f"""with tens as (select book_id as query_id, concat('978', substring(lpad(cast(book_id as varchar(12)), 10, '0'), 1, 9)) as head from books),
             wanted as (select query_id, concat(head, {_check13('head')}) as isbn from tens),
             heads as (select book_id, concat('978', substring(lpad(cast(book_id as varchar(12)), 10, '0'), 1, 9)) as head from isbn_books where not is_deleted),
             known as (select book_id, concat(head, {_check13('head')}) as isbn from heads)
        select w.query_id, w.isbn, k.book_id from wanted w join known k on k.isbn = w.isbn""",
)
register_sql(
    "duplicate_isbn_guard", ["isbn_books"],
    """with incoming as (select book_id + 1000000000 as new_id, case when book_id % 2 = 0 then isbn_13 else concat('979', lpad(cast(book_id % 500 as varchar(12)), 10, '0')) end as isbn_13 from isbn_books),
            firsts as (select isbn_13, min(new_id) as new_id from incoming where isbn_13 is not null group by isbn_13)
       select new_id, isbn_13 from firsts f where not exists (select 1 from isbn_books b where b.isbn_13 = f.isbn_13)
       union all select new_id, isbn_13 from incoming where isbn_13 is null""",
)
# Books that share title and rating are one kind, known by its least book. What is bought is dealt out three times, in two or three numbers a row: by
# order, by book and by library, where the kind of the first book is seen and the books of that kind are listed; candidates do not travel.
_UNOWNED_OF_KIND = """with firsts as (select title, rating, min(book_id) as kind from books group by title, rating),
            kinds as (select b.book_id, b.title, b.is_deleted, f.kind from books b left join firsts f on f.title = b.title and f.rating = b.rating),
            held as (select /*+ REPARTITION(PARTS, library_id) */ b.library_id, b.book_id, k.is_deleted, k.kind from bought b join (select /*+ REPARTITION(PARTS, book_id) */ book_id, is_deleted, kind from kinds) k on k.book_id = b.book_id),
            sought as (select library_id, book_id, kind, min_by(kind, case when not is_deleted then book_id end) over (partition by library_id) as wanted from held),
            lists as (select library_id, wanted, collect_set(book_id) as ids from sought where kind = wanted group by library_id, wanted)
       select l.library_id, c.book_id, c.title from lists l join kinds c on c.kind = l.wanted where not c.is_deleted and not array_contains(l.ids, c.book_id)"""
register(
    "exclude_owned", lambda s, d: over_bought(s, d, _UNOWNED_OF_KIND), ["owned"],
    """with source as (select library_id, min(book_id) as source_id from owned group by library_id),
            candidates as (select s.library_id, c.book_id, c.title from source s join books b on b.book_id = s.source_id join books c on c.title = b.title and c.rating = b.rating where not c.is_deleted)
       select library_id, book_id, title from candidates c where not exists (select 1 from libraries l where l.library_id = c.library_id and l.book_id = c.book_id)""",
)
register_sql(
    "metadata_merge", ["books"],
    """with a as (select book_id, title, case when book_id % 3 = 0 then '' else author end as author, case when book_id % 4 = 0 then 0 else publication_year end as year from books where book_id % 5 <> 0),
            b as (select book_id, concat(title, ' (2)') as title, author, publication_year + 1 as year from books where book_id % 2 = 0)
       select coalesce(a.book_id, b.book_id) as book_id, coalesce(nullif(a.title, ''), b.title) as title, coalesce(nullif(a.author, ''), b.author) as author, coalesce(nullif(a.year, 0), b.year) as year,
              case when a.book_id is not null and b.book_id is not null then 'merged' when a.book_id is not null then 'primary' else 'secondary' end as source
       from a full outer join b on a.book_id = b.book_id""",
)
register_sql(
    "citation_to_book", ["owned"],
    """with context as (select library_id, book_id, title, author, row_number() over (partition by library_id order by book_id) as place from owned),
            cited as (select library_id as response_id, case when place % 3 = 0 then upper(title) when place % 3 = 1 then substring(title, 1, length(title) - 2) else title end as title, author from context where place <= 3),
            pairs as (select c.response_id, c.title as cited_title, k.book_id, k.place, case when lower(c.title) = lower(k.title) then 1
                        when (position(lower(c.title) in lower(k.title)) > 0 or position(lower(k.title) in lower(c.title)) > 0) and (position(lower(c.author) in lower(k.author)) > 0) then 2 else 9 end as tier
                      from cited c join context k on k.library_id = c.response_id),
            best as (select *, row_number() over (partition by response_id, cited_title order by tier, place) as r from pairs where tier < 9)
       select response_id, cited_title, book_id, tier from best where r = 1""",
)
#: Books of a library that meet in one task: a larger library is cut in blocks, and each two of its blocks meet somewhere.
BLOCK = 1024
_LIKENESS = "round((case when a.author = b.author then 0.5 else 0 end) + 0.3 * $SIZE($MEET(a.genres, b.genres)) / greatest($SIZE(a.genres), $SIZE(b.genres)) + (case when abs(a.publication_year - b.publication_year) <= 5 then 0.2 else 0 end), 6) as similarity"
_PAIRED = f"select a.library_id, a.book_id as book_a, b.book_id as book_b, {_LIKENESS}"
_MEET = {"MEET": ("array_intersect", "list_intersect")}
_BLOCKS = f"""with sizes as (select library_id, cast(ceil(count(*) / $BLOCK) as int) as blocks from owned group by library_id),
            books_of as (select o.library_id, o.book_id, o.author, o.genres, o.publication_year, s.blocks from owned o join sizes s on s.library_id = o.library_id),
            small as (select * from books_of where blocks = 1),
            large as (select /*+ REPARTITION(PARTS, library_id, book_id) */ *, cast(pmod(xxhash64(book_id), blocks) as int) as block from books_of where blocks > 1),
            sides as (select *, explode(sequence(0, blocks - 1)) as other from large),
            cells as (select /*+ REPARTITION(PARTS, library_id, low, high) */ library_id, book_id, author, genres, publication_year, block, least(block, other) as low, greatest(block, other) as high from sides)
       {_PAIRED} from small a join small b on a.library_id = b.library_id and a.book_id < b.book_id
       union all
       {_PAIRED} from cells a join cells b on a.library_id = b.library_id and a.low = b.low and a.high = b.high and a.book_id < b.book_id and least(a.block, b.block) = a.low and greatest(a.block, b.block) = a.high"""
register(
    "feature_similarity_join",
    lambda s, d: by_library(s, d, dialect(_BLOCKS.replace("$BLOCK", str(BLOCK)), 0, **_MEET)),
    ["owned"],
    dialect(f"{_PAIRED} from owned a join owned b on a.library_id = b.library_id and a.book_id < b.book_id", 1, **_MEET),
)

# -- windows
register_sql("topk_per_query", ["libraries", "books"], "with ranked as (select l.library_id, l.book_id, b.rating, row_number() over (partition by l.library_id order by b.rating desc, l.book_id) as place from libraries l join books b on b.book_id = l.book_id) select library_id, book_id, rating, place from ranked where place <= 5")
_SCORED = "scored as (select o.library_id as query_id, o.book_id, cast((o.book_id * 37 + o.library_id * 11) % 1000 as double) / 1000 as score from libraries o)"
register_sql("ambiguity_gap", ["libraries"], f"with {_SCORED}, next as (select *, lead(score) over (partition by query_id order by score desc, book_id) as other, lead(book_id) over (partition by query_id order by score desc, book_id) as neighbour from scored) select query_id, book_id, score, coalesce(score - other < 0.05, false) as ambiguous, case when score - other < 0.05 then neighbour end as neighbour from next")
register_sql("needs_verification", ["libraries"], f"with {_SCORED}, next as (select *, row_number() over (partition by query_id order by score desc, book_id) as place, lead(score) over (partition by query_id order by score desc, book_id) as other from scored), best as (select * from next where place = 1) select c.c_custkey as query_id, b.book_id, b.score, b.score is null or b.score < 0.6 or coalesce(b.score - b.other < 0.1, false) as needs_verification, coalesce(b.score >= 0.7, false) as confident from customer c left join best b on b.query_id = c.c_custkey")
register_sql("rerank_order_changed", ["libraries"], f"with {_SCORED}, ranks as (select query_id, book_id, row_number() over (partition by query_id order by score desc, book_id) as r1, row_number() over (partition by query_id order by score + cast(book_id % 7 as double) / 50 desc, book_id) as r2 from scored) select query_id, bool_or(r1 <> r2) as changed, count(*) as considered from ranks group by query_id")
register_dialects("recent_turns", ["turns"], "with placed as (select *, row_number() over (partition by conv_id order by turn desc) as place from turns) select conv_id, $ROLES as roles, count(*) as kept from placed where place <= 4 group by conv_id", ROLES=("array_join(transform(sort_array(collect_list(struct(turn, role))), x -> x.role), ',')", "string_agg(role, ',' order by turn)"))
register_sql("list_conversations", ["turns"], "select conv_id, count(*) as messages, max(turn) as last_turn, concat('Chat ', cast(conv_id as varchar(20))) as title from turns group by conv_id order by last_turn desc, conv_id limit 20")
register_sql("lru_trim", ["latency"], "with used as (select user_id as entry, max(ts) as accessed_at from latency group by user_id), newest as (select * from used where accessed_at >= timestamp '2024-01-05 00:00:00' order by accessed_at desc, entry limit 50) select entry, row_number() over (order by accessed_at desc, entry) as place from newest")
register_sql("cache_lookup", ["latency"], "with cached as (select distinct user_id from latency where event_id % 3 = 0), asked as (select event_id, user_id * 2 as k, ts from latency) select a.k, count(*) as lookups, count(c.user_id) as hits, round(avg(case when c.user_id is not null then 1e0 else 0e0 end), 6) as hit_rate, max(a.ts) as accessed_at from asked a left join cached c on c.user_id = a.k group by a.k")
register_sql("context_window", ["turns"], "with last as (select conv_id, book_id, max(turn) as turn from turns group by conv_id, book_id), placed as (select *, row_number() over (partition by conv_id order by turn desc, book_id) as place from last) select conv_id, book_id, turn, place from placed where place <= 10")

# -- sets and merges
register_sql("union_dedup_isbn", ["isbn_books"], "with both_sources as (select book_id, coalesce(isbn_13, isbn_10) as isbn, 1 as source from isbn_books union all select book_id + 1000000000, coalesce(isbn_13, isbn_10), 2 from isbn_books where book_id % 2 = 0), placed as (select *, row_number() over (partition by isbn order by source, book_id) as place from both_sources where isbn is not null) select book_id, isbn, source from placed where place = 1 union all select book_id, isbn, source from both_sources where isbn is null")
register_sql("dedup_recommendations", ["owned"], "with all_found as (select library_id, lower(title) as title, lower(author) as author, book_id, book_id % 3 as strategy, 0.5 + 0.1 * (book_id % 4) as confidence from owned), placed as (select *, row_number() over (partition by library_id, title, author order by strategy, book_id) as place from all_found) select library_id, title, author, book_id, round(confidence, 6) as confidence from placed where place = 1")
register_sql("latest_wins_upsert", ["books"], "with rows_in as (select book_id, title, rating, 1 as version from books union all select book_id, concat(title, ' v2'), rating, 2 from books where book_id % 3 = 0 union all select book_id, concat(title, ' v3'), rating, 3 from books where book_id % 9 = 0), placed as (select *, row_number() over (partition by book_id order by version desc) as place from rows_in) select book_id, title, rating, version from placed where place = 1")
register_sql("soft_delete_apply", ["books"], "with gone as (select book_id from books where book_id % 11 = 0) select b.book_id, b.title, b.is_deleted or g.book_id is not null as is_deleted from books b left join gone g on g.book_id = b.book_id")
register_by_library(
    "missing_genres",
    "with present as (select distinct library_id, $EXPLODE(genres) as genre from owned), libs as (select distinct library_id from owned), major as (select $EXPLODE($ARRAY('ring', 'bolt', 'gear', 'gizmo', 'plate', 'rod', 'widget', 'anvil')) as genre) select l.library_id, m.genre from libs l cross join major m left join present p on p.library_id = l.library_id and p.genre = m.genre where p.genre is null",
)
