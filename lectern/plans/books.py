"""Scans, filters, paging and statistics of the book table, each one Spark SQL statement."""

from lectern.registry import register_by_library, register_sql

LIVE = "not is_deleted"

register_sql("scan_books", ["books"], f"select book_id, title, author, publication_year, read_status, rating from books where {LIVE}")
register_sql("book_by_id", ["books"], f"select book_id, title, author, publication_year from books where book_id = 42 and {LIVE}")
register_sql("book_by_isbn", ["isbn_books"], f"select book_id, title, isbn_10, isbn_13 from isbn_books where {LIVE} and (isbn_13 = replace(replace('978-0000-000-04 0', '-', ''), ' ', '') or isbn_10 = replace(replace('0-000-0000 40', '-', ''), ' ', ''))")
register_sql("search_ilike", ["isbn_books"], f"select book_id, title, author from isbn_books where {LIVE} and (title ilike '%anvil%' or author ilike '%anvil%' or isbn_13 ilike '%anvil%' or isbn_10 ilike '%anvil%') order by book_id limit 50")
register_sql("filter_genre", ["books"], f"select book_id, title from books where {LIVE} and array_contains(genres, 'widget')")
register_sql("filter_year_range", ["books"], f"select book_id, title, publication_year from books where {LIVE} and publication_year between 1950 and 1960")
register_sql(
    "filter_retrieved", ["books"],
    f"select book_id, title, author, publication_year from books where {LIVE} and arrays_overlap(transform(genres, g -> lower(g)), array('gear', 'rod')) and publication_year between 1920 and 1980 and author in ('Brand#2', 'Brand#4', 'Brand#17')",
    f"select book_id, title, author, publication_year from books where {LIVE} and list_has_any(list_transform(genres, lambda g: lower(g)), ['gear', 'rod']) and publication_year between 1920 and 1980 and author in ('Brand#2', 'Brand#4', 'Brand#17')",
)
register_sql(
    "paged_list", ["books"],
    f"""with found as (select book_id, title, rating from books where {LIVE} and read_status = 'read'), head as (select * from found order by rating desc, book_id limit 40),
             numbered as (select *, row_number() over (order by rating desc, book_id) as place from head)
        select book_id, title, rating, total, total > 40 as has_more, place from numbered cross join (select count(*) as total from found) t where place between 21 and 40""",
)
register_sql(
    "validate_books", ["isbn_books"],
    """with checked as (
         select book_id,
           length(coalesce(title, '')) between 1 and 500 as ok_title, length(coalesce(author, '')) between 1 and 200 as ok_author,
           coalesce(isbn_13 rlike '^[0-9]{13}$', true) as ok_isbn_13, coalesce(isbn_10 rlike '^[0-9]{9}[0-9X]$', true) as ok_isbn_10,
           coalesce(publication_year between 1000 and 2100, true) as ok_year, coalesce(page_count >= 1, true) as ok_pages,
           coalesce(rating between 1 and 5, true) as ok_rating, coalesce(read_status in ('unread', 'reading', 'read', 'dnf'), true) as ok_status
         from isbn_books)
       select book_id, concat_ws(',', case when not ok_title then 'title' end, case when not ok_author then 'author' end, case when not ok_isbn_13 then 'isbn_13' end,
              case when not ok_isbn_10 then 'isbn_10' end, case when not ok_year then 'year' end, case when not ok_pages then 'pages' end,
              case when not ok_rating then 'rating' end, case when not ok_status then 'status' end) as failed,
              ok_title and ok_author and ok_isbn_13 and ok_isbn_10 and ok_year and ok_pages and ok_rating and ok_status as valid from checked""",
    """with checked as (
         select book_id,
           length(coalesce(title, '')) between 1 and 500 as ok_title, length(coalesce(author, '')) between 1 and 200 as ok_author,
           coalesce(regexp_matches(isbn_13, '^[0-9]{13}$'), true) as ok_isbn_13, coalesce(regexp_matches(isbn_10, '^[0-9]{9}[0-9X]$'), true) as ok_isbn_10,
           coalesce(publication_year between 1000 and 2100, true) as ok_year, coalesce(page_count >= 1, true) as ok_pages,
           coalesce(rating between 1 and 5, true) as ok_rating, coalesce(read_status in ('unread', 'reading', 'read', 'dnf'), true) as ok_status
         from isbn_books)
       select book_id, concat_ws(',', case when not ok_title then 'title' end, case when not ok_author then 'author' end, case when not ok_isbn_13 then 'isbn_13' end,
              case when not ok_isbn_10 then 'isbn_10' end, case when not ok_year then 'year' end, case when not ok_pages then 'pages' end,
              case when not ok_rating then 'rating' end, case when not ok_status then 'status' end) as failed,
              ok_title and ok_author and ok_isbn_13 and ok_isbn_10 and ok_year and ok_pages and ok_rating and ok_status as valid from checked""",
)

# -- statistics
register_sql(
    "library_stats", ["isbn_books"],
    f"""select count(*) as total, count(case when isbn_13 is not null or isbn_10 is not null then 1 end) as with_isbn,
               count(case when read_status in ('read', 'completed') then 1 end) as read_books, count(case when read_status = 'unread' then 1 end) as unread_books,
               count(case when read_status = 'reading' then 1 end) as reading_books from isbn_books where {LIVE}""",
)
GENRES = f"(select book_id, added_at, explode(genres) as genre from books where {LIVE})"
GENRES_DUCK = f"(select book_id, added_at, unnest(genres) as genre from books where {LIVE})"


def _both(key: str, body: str) -> None:
    register_sql(key, ["books"], body.replace("GENRES", GENRES), body.replace("GENRES", GENRES_DUCK))


_both("genre_distribution", "select genre, count(*) as books from GENRES g group by genre")
_both(
    "genre_share_topn",
    """with total as (select count(*) as n from books where not is_deleted), counted as (select genre, count(*) as books from GENRES g group by genre)
       select genre, books, round(100.0 * books / n, 1) as percentage from counted cross join total order by books desc, genre limit 6""",
)
_both(
    "genre_trends",
    """with counted as (select genre, count(*) as total, count(case when added_at >= timestamp '1998-06-01' then 1 end) as recent from GENRES g group by genre)
       select genre, total, recent, round(cast(recent as double) / total, 6) as share, case when cast(recent as double) / total > 0.4 then 'increasing' when cast(recent as double) / total < 0.1 then 'decreasing' else 'stable' end as trend
       from counted where total >= 2 order by total desc, genre limit 10""",
)
register_sql("author_stats", ["books"], f"select author, count(*) as books from books where {LIVE} group by author order by books desc, author limit 10")
register_sql("year_range", ["books"], f"select min(publication_year) as earliest, max(publication_year) as latest from books where {LIVE} and publication_year > 1000 and publication_year <= 2027")
register_sql("monthly_additions", ["books"], f"select date_format(added_at, 'yyyy-MM') as month, count(*) as books from books where {LIVE} and added_at is not null group by 1", f"select strftime(added_at, '%Y-%m') as month, count(*) as books from books where {LIVE} and added_at is not null group by 1")
register_sql("conversation_stats", ["turns"], "select conv_id, count(*) as messages, cast(sum(coalesce(token_count, 0)) as bigint) as tokens from turns group by conv_id")
register_sql(
    "job_durations", [],
    """select o_orderstatus as status, count(*) as jobs, cast(sum(datediff(l.done, o.o_orderdate)) as bigint) as days, cast(sum(l.items) as bigint) as detected
       from orders o join (select l_orderkey, cast(max(l_shipdate) as date) as done, count(*) as items from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey group by o_orderstatus""",
    """select o_orderstatus as status, count(*) as jobs, cast(sum(datediff('day', cast(o.o_orderdate as date), l.done)) as bigint) as days, cast(sum(l.items) as bigint) as detected
       from orders o join (select l_orderkey, cast(max(l_shipdate) as date) as done, count(*) as items from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey group by o_orderstatus""",
)
register_sql(
    "reading_sessions", ["latency"],
    "select user_id as book_id, count(*) as sessions, cast(sum(cast(ms as bigint) % 50) as bigint) as pages, cast(sum(unix_millis(cast(ts as timestamp) + make_dt_interval(0, 0, cast(event_id % 90 as int))) - unix_millis(cast(ts as timestamp))) as bigint) as elapsed_ms from latency group by user_id",
    "select user_id as book_id, count(*) as sessions, cast(sum(cast(trunc(ms) as bigint) % 50) as bigint) as pages, cast(sum((event_id % 90) * 60000) as bigint) as elapsed_ms from latency group by user_id",
)
register_sql("detection_summary", ["boxes"], "select image_id, count(*) as detected, count(case when confidence >= 0.95 then 1 end) as identified, round(avg(confidence), 6) as mean_confidence from boxes group by image_id")
register_sql("cache_stats", ["latency"], "select stage as kind, user_id % 3 as model, count(*) as entries from latency group by grouping sets ((), (stage), (user_id % 3))", "select stage as kind, user_id % 3 as model, count(*) as entries from latency group by grouping sets ((), (stage), (user_id % 3))")
register_sql(
    "index_stats", ["visual_vectors"],
    "select modality, count(*) as vectors, min(cast(size(embedding) as int)) as min_dim, max(cast(size(embedding) as int)) as max_dim from (select 'text' as modality, embedding from embeddings union all select 'visual', embedding from visual_vectors) v group by modality",
    "select modality, count(*) as vectors, min(cast(len(embedding) as int)) as min_dim, max(cast(len(embedding) as int)) as max_dim from (select 'text' as modality, embedding from embeddings union all select 'visual', embedding from visual_vectors) v group by modality",
)
#: Genres of which every library is expected to hold one in MINOR at least, in order.
MAJOR, MINOR = ("ring", "bolt", "gear", "gizmo", "plate", "rod", "widget", "anvil"), 20
FAVORITES = 5


def _listed(value: str, where: str = "true") -> tuple[str, str]:
    """Values of a group by place, joined by commas."""
    return f"array_join(transform(sort_array(collect_list(case when {where} then struct(place, {value}) end)), x -> x.{value}), ',')", f"string_agg(case when {where} then {value} end, ',' order by place)"


# shares are worked out in whole millionths, which both engines round alike
_LACKING = ", ".join(f"case when coalesce(max(case when genre = '{g}' then n end), 0) * {MINOR} < max(total) then '{g}' end" for g in MAJOR)
_PROFILE = f"""with g as (select library_id, $EXPLODE(genres) as genre from owned), counted as (select library_id, lower(genre) as genre, count(*) as n from g group by library_id, lower(genre)),
      ranked as (select *, row_number() over (partition by library_id order by n desc, genre) as place, cast(sum(n) over (partition by library_id) as bigint) as total from counted),
      parts as (select *, (n * 2000000 + total) $IDIV (2 * total) as millionths from ranked),
      told as (select *, concat(genre, ':', cast(millionths $IDIV 1000000 as varchar(1)), '.', lpad(cast(millionths % 1000000 as varchar(6)), 6, '0')) as share from parts),
      top as (select library_id, $TOP as top_genres, $SHARES as distribution, count(*) as genres, concat_ws(',', {_LACKING}) as under_represented from told group by library_id),
      by_author as (select library_id, author, count(*) as n, sum(nullif(publication_year, 0)) as years, count(nullif(publication_year, 0)) as dated from owned group by library_id, author), liked as (select *, row_number() over (partition by library_id order by n desc, author) as place from by_author),
      fans as (select library_id, $AUTHORS as favorite_authors from liked where place <= {FAVORITES} and n >= 2 group by library_id),
      years as (select library_id, cast(sum(n) as bigint) as books, coalesce(cast(sum(years) as double) / nullif(sum(dated), 0), 2000e0) as y from by_author group by library_id)
    select y.library_id, books, top_genres, distribution, coalesce(genres, 0) as genres, coalesce(under_represented, '{','.join(MAJOR)}') as under_represented, favorite_authors, round(y, 4) as mean_year,
      case when y >= 2010 then 'contemporary' when y >= 1990 then 'modern' when y >= 1950 then 'mid-century' else 'classic' end as era
    from years y left join top t on t.library_id = y.library_id left join fans f on f.library_id = y.library_id"""
register_by_library("profile_agg", _PROFILE, IDIV=("div", "//"), TOP=_listed("genre", f"place <= {FAVORITES}"), SHARES=_listed("share"), AUTHORS=_listed("author"))
