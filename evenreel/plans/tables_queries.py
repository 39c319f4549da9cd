"""Queries over sources, scalar functions, filters and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenreel.functions import numeric as num
from evenreel.functions import text as tx
from evenreel.operators import archive, crowd, resolution, retrieval
from evenreel.operators import catalogue as cat
from evenreel.operators import interactions as inter
from evenreel.plans.oracle import band, band_no, marker, norm, statement, variants
from evenreel.plans.registry import query, r6
from evenreel.session import scratch_path, sized_shuffles, written
from evenreel.sources import archive as archive_source
from evenreel.sources import dumps, export, payloads, store
from evenreel.sources.files import read_text_csv
from evenreel.streaming import status
from evenreel.streaming import store as streams

# -- sources -----------------------------------------------------------------


@query(
    "scan_flat_csv",
    "select event_id::varchar as event_id, event_type as name, value::varchar as value from events",
)
def scan_flat_csv(t):
    path = scratch_path(t.spark, "flat")
    t.raw("events").select("event_id", F.col("event_type").alias("name"), "value").write.csv(
        path, header=True
    )
    return read_text_csv(t.spark, path)


@query(
    "interactions",
    statement(
        """select film_key, title, year, kind, value, rewatch, source, deleted, count(*) as n from (
             select p_partkey::varchar as film_key, p_name as title, p_size + 1950 as year, 'rating' as kind,
                    ((p_size % 10 + 1)::double / 2) as value, null::boolean as rewatch, 'ratings.csv' as source, false as deleted from part
             union all
             select p_partkey::varchar, p_name, p_size + 1950, 'watched', null, null, 'watched.csv', false from part
             union all
             select p_partkey::varchar, p_name, p_size + 1950, 'watchlist', null, null, 'watchlist.csv', false
             from part where p_type = 'PROMO'
             union all
             select coalesce(k.film_key, 'ty:' || lower(o.p_name) || ':' || (o.p_size + 1950)), o.p_name, o.p_size + 1950,
                    'diary', (o.p_size % 10 + 1)::double / 2, o.p_type = 'LARGE', 'diary.csv', false
             from part o left join (select p_name, p_size, min(p_partkey::varchar) as film_key from part group by all) k
               on k.p_name = o.p_name and k.p_size = o.p_size)
           group by all"""
    ),
)
def interactions(t):
    """An export written from the parts and loaded back."""
    folder = scratch_path(t.spark, "export")
    key = F.col("p_partkey")
    flat = t.raw("part").select(
        F.lit("2024-05-06").alias("Date"),
        F.col("p_name").alias("Name"),
        (F.col("p_size") + 1950).alias("Year"),
        F.concat(F.lit("https://films.example/film/"), key.cast("string"), F.lit("/")).alias("Film URI"),
        ((F.col("p_size") % 10 + 1) / F.lit(2.0)).alias("Rating"),
        F.when(F.col("p_type") == "LARGE", "Yes").alias("Rewatch"),
        "p_type",
    )
    common = ["Date", "Name", "Year", "Film URI"]
    flat.select(*common, "Rating").write.csv(f"{folder}/ratings.csv", header=True)
    flat.select(*common).write.csv(f"{folder}/watched.csv", header=True)
    flat.where(F.col("p_type") == "PROMO").select(*common).write.csv(f"{folder}/watchlist.csv", header=True)
    flat.select(*common, "Rating", "Rewatch").write.csv(f"{folder}/diary.csv", header=True)
    loaded = export.load_export(t.spark, folder)
    return loaded.groupBy(
        "film_key", "title", "year", "kind", "value", "rewatch", "source", "deleted"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "list_blocks",
    """select 'lists/' || p_partkey as source, p_type as list_name, p_brand as tags, name, year::varchar as year, url from (
         select *, p_name || ', ' || p_brand as name, p_size + 1950 as year, 'https://films.example/' || p_partkey as url from part
         union all select *, p_name, p_size + 1950, null from part)
       where p_type <> 'PROMO'""",
)
def list_blocks(t):
    p = t.raw("part")
    magic = F.when(F.col("p_type") == "PROMO", "some other file").otherwise("Site list export v7")
    year = (F.col("p_size") + 1950).cast("string")
    text = F.concat(
        magic,
        F.lit("\r\nDate,Tags,Name,URL,Description\r\n2024-01-01,"),
        F.col("p_brand"),
        F.lit(","),
        F.col("p_type"),
        F.lit(",,\"so far:\r\n\r\n\"\"best\"\" first\"\r\n\r\nPosition,Name,Year,URL,Description\r\n1,\""),
        F.concat("p_name", F.lit(", "), "p_brand"),
        F.lit('",'),
        year,
        F.concat(F.lit(",https://films.example/"), F.col("p_partkey").cast("string")),
        F.lit(",\"seen twice,\r\nonce with \"\"friends\"\"\"\r\n2,"),
        F.col("p_name"),
        F.lit(","),
        year,
        F.lit(",,\r\n"),
    )
    files = p.select(F.concat(F.lit("lists/"), F.col("p_partkey").cast("string")).alias("source"), text.alias("value"))
    return export.list_blocks(files).select("source", "list_name", "tags", "name", "year", "url")


@query(
    "diary_resolve",
    statement(
        """select d.user_id, d.film_key as entry,
                  coalesce(k.film_key, 'ty:' || """
        + norm("d.title")
        + """ || ':' || d.year) as film_key, count(*) as n
           from (select * from inter where kind = 'diary') d
           left join (select """
        + norm("title")
        + """ as form, year, min(film_key) as film_key from inter where kind = 'rating' group by all) k
             on k.form = """
        + norm("d.title")
        + """ and k.year = d.year group by all""",
        "inter",
    ),
)
def diary_resolve(t):
    rows = t.interactions()
    lookup = export.title_lookup(rows.where(F.col("kind") == "rating").withColumn("seq", F.lit(0)))
    diary = rows.where(F.col("kind") == "diary").withColumn("entry", F.col("film_key"))
    return export.resolve_diary(diary, lookup).groupBy("user_id", "entry", "film_key").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "id_export",
    """select p_partkey as tmdb_id, p_name as original_title, p_retailprice as export_popularity
       from part where p_type <> 'PROMO'""",
)
def id_export(t):
    path = scratch_path(t.spark, "ids")
    t.raw("part").select(
        F.lit(False).alias("adult"),
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("original_title"),
        F.col("p_retailprice").alias("popularity"),
        (F.col("p_type") == "PROMO").alias("video"),
    ).write.json(path, compression="gzip")
    return dumps.most_popular_first(dumps.id_export(dumps.read_id_export(t.spark, path)))


@query(
    "crowd_scan",
    statement(
        """select 'member ' || member as member,
                  case item when 0 then 'null' when 1 then 'nan' when 2 then '' else 's' || item end as slug,
                  rating, count(*) as n from ratings10 group by all""",
        "ratings10",
    ),
)
def crowd_scan(t):
    path = scratch_path(t.spark, "dump")
    item = F.col("item")
    slug = F.when(item == 0, "null").when(item == 1, "nan").when(item == 2, "")
    t.ratings10().select(
        F.concat(F.lit(" MEMBER "), F.col("member").cast("string"), F.lit(" ")).alias("user_name"),
        slug.otherwise(F.concat(F.lit("s"), item.cast("string"))).alias("film_id"),
        (F.col("rating") / F.lit(2.0)).alias("rating"),
    ).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = dumps.read_crowd_ratings(
        t.spark, path, member="user_name", slug="film_id", rating="rating", doubled=True
    )
    return rows.groupBy("member", "slug", "rating").agg(F.count(F.lit(1)).alias("n"))


_DUMP_COLUMNS = [
    "movie_id", "tmdb_id", "imdb_id", "movie_title", "year_released", "release_date", "runtime", "overview",
    "genres", "production_countries", "original_language", "vote_average", "vote_count",
]


def _dump_lines(t):
    """The parts as a scraped film table: some lines cut short, some cells malformed."""
    p = t.raw("part")
    key, size, kind = F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_type")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    genres = F.when(kind == "LARGE", quoted(F.lit("[broken"))).otherwise(
        quoted(F.concat(F.lit('[""'), kind, F.lit('"", ""'), F.col("p_brand"), F.lit('""]')))
    )
    cells = [
        F.concat(F.lit("s"), key),
        F.when(kind == "SMALL", F.lit("")).otherwise(F.concat(key, F.lit(".0"))),
        F.concat(F.lit("tt"), key),
        quoted(F.concat("p_name", F.lit(", "), "p_brand")),
        (size + 1950).cast("string"),
        F.lit(""),
        F.when(size > 25, F.lit("0")).otherwise((size + 60).cast("string")),
        quoted(F.concat(F.lit("two lines of "), F.col("p_name"), F.lit("\nby "), F.col("p_brand"))),
        genres,
        F.lit(""),
        F.lower(F.substring(kind, 1, 2)),
        F.when(kind == "ECONOMY", F.lit("nan")).otherwise(F.lit("6.5")),
        size.cast("string"),
    ]
    whole = F.concat_ws(",", *cells)
    cut_short = F.concat_ws(",", *cells[:5])
    return p.select(F.when((kind == "PROMO") & (size > 40), cut_short).otherwise(whole).alias("value"))


def _ragged_table(t):
    path = scratch_path(t.spark, "ragged")
    _dump_lines(t).write.text(path)
    return dumps.read_ragged(t.spark, path, _DUMP_COLUMNS, header=False)


@query(
    "ragged_scan",
    """select 'intact' as part, count(*) as n from part where not (p_type = 'PROMO' and p_size > 40)
       union all select 'skipped', count(*) from part where p_type = 'PROMO' and p_size > 40""",
)
def ragged_scan(t):
    return dumps.scan_counts(_ragged_table(t))


@query(
    "catalogue_scan",
    """select 'intact' as part, count(*) as n from part where not (p_type = 'PROMO' and p_size > 40) and p_type <> 'SMALL'
       union all select 'skipped', count(*) from part where (p_type = 'PROMO' and p_size > 40) or p_type = 'SMALL'""",
)
def catalogue_scan(t):
    """What the dump catalogue takes and leaves out: rows cut short, and rows without an id or a title."""
    return dumps.scan_counts(_ragged_table(t), dumps.names_a_film())


@query(
    "dump_catalogue",
    """select p_partkey as tmdb_id, 'tt' || p_partkey as imdb_id, p_name || ', ' || p_brand as title,
              p_size + 1950 as year, case when p_size <= 25 then p_size + 60 end as runtime,
              'two lines of ' || p_name || chr(10) || 'by ' || p_brand as overview,
              case when p_type = 'LARGE' then '' else p_type || '|' || p_brand end as genres,
              '' as countries, lower(substr(p_type, 1, 2)) as original_language,
              case when p_type <> 'ECONOMY' then 6.5::double end as vote_average, p_size::bigint as vote_count
       from part where not (p_type = 'PROMO' and p_size > 40) and p_type <> 'SMALL'""",
)
def dump_catalogue(t):
    films = dumps.dump_catalogue(dumps.intact(_ragged_table(t)))
    return films.select(
        "tmdb_id",
        "imdb_id",
        "title",
        "year",
        "runtime",
        "overview",
        F.array_join("genres", "|").alias("genres"),
        F.array_join("production_countries", "|").alias("countries"),
        "original_language",
        "vote_average",
        "vote_count",
    )


@query(
    "ml_prepare",
    statement(
        """select 'ratings' as member, count(*) as n, sum(userId)::bigint as ids, round(sum(rating), 3) as total from mr
           union all select 'links', count(*), sum(movieId)::bigint, round(sum(tmdbId), 3) from links""",
        "mr",
        "links",
    ),
)
def ml_prepare(t):
    """Archive members written as CSV, converted to typed parquet, read back."""
    folder, out = scratch_path(t.spark, "archive"), scratch_path(t.spark, "prepared")
    ratings = t.model_ratings().select("userId", "movieId", "rating", F.lit(0).alias("timestamp"))
    ratings.write.csv(f"{folder}/ratings.csv", header=True)
    t.links().select("movieId", "imdbId", "tmdbId").write.csv(f"{folder}/links.csv", header=True)
    archive_source.prepare(t.spark, folder, out)
    archive_source.prepare(t.spark, folder, out)  # converted members are left alone
    r = archive_source.load(t.spark, out, "ratings")
    links = archive_source.load(t.spark, out, "links")
    total = lambda c: F.round(F.sum(c).cast("double"), 3).alias("total")
    return r.agg(
        F.lit("ratings").alias("member"), F.count(F.lit(1)).alias("n"), F.sum("userId").alias("ids"), total("rating")
    ).unionByName(
        links.agg(
            F.lit("links").alias("member"), F.count(F.lit(1)).alias("n"), F.sum("movieId").alias("ids"), total("tmdbId")
        )
    )


@query(
    "pending_ids",
    statement("select tmdb_id from films where tmdb_id not in (select doc_id from documents)", "films"),
)
def pending_ids(t):
    stored = t.raw("documents").select(F.col("doc_id").alias("tmdb_id"))
    return store.pending_ids(t.films().select("tmdb_id"), stored)


@query(
    "load_store",
    """select l_partkey as tmdb_id, l_orderkey as batch_record from lineitem
       qualify row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) = 1""",
)
def load_store(t):
    batches = t.raw("lineitem").select(
        F.col("l_partkey").alias("tmdb_id"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("batch"),
        F.col("l_orderkey").alias("batch_record"),
    )
    return store.load_store(batches)


@query(
    "enrich_missing",
    statement(
        """select distinct m.tmdb_id, m.media_type from film_map m
           where m.tmdb_id is not null
             and not exists (select 1 from films f where f.tmdb_id = m.tmdb_id and f.media_type = m.media_type)""",
        "film_map",
        "films",
    ),
)
def enrich_missing(t):
    return store.missing_titles(t.film_map(), t.films().select("tmdb_id", "media_type"))


@query(
    "stream_ingest",
    statement("select tmdb_id, title, vote_count from films", "films"),
)
def stream_ingest(t):
    """Films streamed in as files, twice over: the store holds each id once."""
    inbox, out, ck = (scratch_path(t.spark, n) for n in ("inbox", "store", "stream"))
    batch = t.films().select("tmdb_id", "title", "vote_count")
    batch.write.parquet(inbox)
    for _ in range(2):
        stream = streams.file_stream(t.spark, inbox, batch.schema)
        streams.ingest_store(stream, out, ck).awaitTermination()
        batch.write.mode("append").parquet(inbox)
    return t.spark.read.schema(batch.schema).parquet(out)


_COVERAGE = """select kind, count(*) as rows, count(distinct film_key) as films, count(value) as with_value,
                      kind in ('diary', 'list_entry') as optional from inter group by kind"""


@query("stream_coverage", statement(_COVERAGE, "inter"))
def stream_coverage(t):
    inbox, state, ck = (scratch_path(t.spark, n) for n in ("inbox", "state", "stream"))
    rows = t.interactions().select("kind", "film_key", "value")
    rows.repartition(4).write.parquet(inbox)
    stream = streams.file_stream(t.spark, inbox, rows.schema, files_per_batch=2)
    streams.stream_coverage(stream, state, ck).awaitTermination()
    return streams.coverage_from_state(t.spark.read.parquet(state).drop("batch"))


STATUS_KEYS = ["user_id", "film_key"]


@query(
    "stream_status",
    statement("select user_id, film_key, title, year, seen, rating, liked, on_watchlist, watchlist_pending from status", "status"),
)
def stream_status(t):
    """Film status drained in several batches and merged on the way; the last batch comes twice."""
    inbox, state, ck = (scratch_path(t.spark, n) for n in ("inbox", "state", "stream"))
    rows = t.interactions()
    rows.repartition(6).write.parquet(inbox)
    stream = streams.file_stream(t.spark, inbox, rows.schema, files_per_batch=1)
    status.stream_status(stream, state, ck, STATUS_KEYS, compact_every=3).awaitTermination()
    again = t.spark.read.schema(rows.schema).parquet(inbox)
    status.fold_batch(again, 0, state, STATUS_KEYS)  # taken in already
    return status.status_from_state(t.spark, state, STATUS_KEYS)


@query("store_damage", statement("select tmdb_id from films where tmdb_id % 4 = 0", "films"))
def store_damage(t):
    """Ids to fetch again after the file of every fourth film has been torn."""
    path = scratch_path(t.spark, "store")
    batch = t.films().select("tmdb_id", "title", "vote_count")
    for part in range(4):
        batch.where(F.col("tmdb_id") % 4 == part).coalesce(1).write.parquet(f"{path}/part={part}")
    manifest = written(store.store_manifest(t.spark, path, batch.schema), "manifest")
    tear_files(t.spark, f"{path}/part=0/*.parquet")
    return store.pending_ids(batch.select("tmdb_id"), store.load_healthy(t.spark, path, batch.schema, manifest))


def tear_files(spark, pattern: str) -> None:
    """Overwrite files by a few bytes, as an interrupted write leaves them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(where):
        out = system.create(found.getPath(), True)
        out.writeBytes("PAR1 torn")
        out.close()


# -- scalar functions ----------------------------------------------------------


@query(
    "normalize_title",
    "select source, id, title_form, length(title_form) as n_chars from (select 'page' as source, page_id as id, "
    + norm("regexp_extract(html, '<title>([^<]*)</title>', 1)")
    + " as title_form from pages union all select 'part', p_partkey, "
    + norm("p_name || ' ' || p_brand")
    + " from part)",
)
def normalize_title(t):
    pages = t.raw("pages").select(
        F.lit("page").alias("source"),
        F.col("page_id").alias("id"),
        tx.normalize_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_form"),
    )
    parts = t.raw("part").select(
        F.lit("part").alias("source"),
        F.col("p_partkey").alias("id"),
        tx.normalize_title(F.concat("p_name", F.lit(" "), "p_brand")).alias("title_form"),
    )
    return pages.unionByName(parts).withColumn("n_chars", F.length("title_form"))


@query(
    "film_slug",
    """select page_id, nullif(trim(string_split(regexp_replace(url, '/+$', ''), '/')[-1]), '') as slug from pages""",
)
def film_slug(t):
    return t.raw("pages").select("page_id", tx.film_slug(F.col("url")).alias("slug"))


@query(
    "year_parse",
    """select o_orderkey, try_cast(trim(' ' || year(o_orderdate) || ' ') as integer) as year,
              try_cast(o_orderstatus as integer) as bad, year(o_orderdate)::integer as released from orders""",
)
def year_parse(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.raw("orders").select(
        "o_orderkey",
        tx.parse_year(F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" "))).alias("year"),
        tx.parse_year(F.col("o_orderstatus")).alias("bad"),
        tx.release_year(day).cast("int").alias("released"),
    )


@query(
    "title_year_key",
    "select p_partkey, 'ty:' || "
    + norm("p_name || ': ' || p_brand")
    + " || ':' || coalesce((case when p_size > 3 then p_size + 1950 end)::varchar, '?') as film_key from part",
)
def title_year_key(t):
    year = F.when(F.col("p_size") > 3, F.col("p_size") + 1950)
    return t.raw("part").select(
        "p_partkey", tx.title_year_key(F.concat("p_name", F.lit(": "), "p_brand"), year).alias("film_key")
    )


def _with_articles(column: str) -> str:
    return (
        f"case p_type when 'ECONOMY' then 'The ' || {column} when 'LARGE' then {column} || ', La' "
        f"when 'SMALL' then 'Der ' || {column} || ' the' else {column} end"
    )


@query(
    "title_variants",
    "select p_partkey, array_to_string(list_sort("
    + variants(norm(_with_articles("p_name")))
    + "), '|') as forms from part",
)
def title_variants(t):
    title = F.expr(_with_articles("p_name"))
    forms = tx.title_variants(tx.normalize_title(title))
    return t.raw("part").select("p_partkey", F.array_join(F.array_sort(forms), "|").alias("forms"))


@query(
    "sequel_guard",
    f"""select p_partkey, {marker(norm("p_name || ' ' || p_brand"))} as mark,
               {marker(norm("p_name"))} as plain_mark,
               {marker(norm("p_name || ' II'"))} as roman_mark,
               ({marker(norm("p_name || ' ' || p_brand"))}) is distinct from ({marker(norm("p_name"))}) as conflict,
               (({marker(norm("p_name || ' ' || p_brand"))}) is distinct from ({marker(norm("p_name"))}))
               and (({marker(norm("p_name || ' ' || p_brand"))}) is distinct from ({marker(norm("'x ' || p_brand"))})) as conflict_any
        from part""",
)
def sequel_guard(t):
    full = tx.normalize_title(F.concat("p_name", F.lit(" "), "p_brand"))
    short = tx.normalize_title(F.col("p_name"))
    other = tx.normalize_title(F.concat(F.lit("x "), "p_brand"))
    return t.raw("part").select(
        "p_partkey",
        tx.sequel_marker(full).alias("mark"),
        tx.sequel_marker(short).alias("plain_mark"),
        tx.sequel_marker(tx.normalize_title(F.concat("p_name", F.lit(" II")))).alias("roman_mark"),
        tx.sequel_conflict(full, F.array(short)).alias("conflict"),
        tx.sequel_conflict(full, F.array(short, other)).alias("conflict_any"),
    )


@query(
    "imdb_tt",
    """select o_orderkey, 'tt' || lpad((o_orderkey * 997)::varchar, greatest(7, length((o_orderkey * 997)::varchar))::integer, '0') as imdb_id
       from orders""",
)
def imdb_tt(t):
    return t.raw("orders").select("o_orderkey", tx.imdb_tt(F.col("o_orderkey") * 997).alias("imdb_id"))


@query(
    "ten_point",
    statement("select member, item, rating, (rating::double / 2)::varchar as stars, count(*) as n from ratings10 group by all", "ratings10"),
)
def ten_point(t):
    stars = t.ratings10().withColumn("stars", (F.col("rating") / F.lit(2.0)).cast("string"))
    doubled = num.ten_point(stars.withColumn("rating", F.col("stars")), "rating", doubled=True)
    return doubled.groupBy("member", "item", "rating", "stars").agg(F.count(F.lit(1)).alias("n"))


@query(
    "popularity_band",
    statement(f"select tmdb_id, vote_count, {band('vote_count')} as band, {band_no('vote_count')} as band_no from films", "films"),
)
def popularity_band(t):
    votes = F.col("vote_count")
    return t.films().select(
        "tmdb_id", "vote_count", num.popularity_band(votes).alias("band"), num.band_ordinal(votes).alias("band_no")
    )


@query(
    "crowd_shrunk",
    statement(
        """select tmdb_id, round((vote_count * coalesce(a, 6.5::double) + 50 * 6.5::double) / (vote_count + 50), 6) as score
           from (select tmdb_id, vote_count, case when year > 1955 then vote_average end as a from films)""",
        "films",
    ),
)
def crowd_shrunk(t):
    average = F.when(F.col("year") > 1955, F.col("vote_average"))
    return t.films().select(
        "tmdb_id", F.round(num.crowd_shrunk(average, F.col("vote_count")), 6).alias("score")
    )


@query(
    "list_document",
    statement(
        """select tmdb_id, array_to_string(list_transform(list_filter("cast", lambda x: trim(x) <> ''),
             lambda x: replace(lower(trim(x)), ' ', '_')), ' ') as doc from films""",
        "films",
    ),
)
def list_document(t):
    return t.films().select("tmdb_id", tx.list_document(F.col("cast")).alias("doc"))


@query(
    "json_list",
    """select event_id, case when event_type = 'view' then 'a|' || user_id when event_type = 'error' then '' else event_type end as items,
              case when event_type = 'click' then null else value end as number from events""",
)
def json_list(t):
    user = F.col("user_id").cast("string")
    cell = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('["a", '), user, F.lit("]")))
        .when(F.col("event_type") == "error", F.lit("[broken"))
        .otherwise(F.concat(F.lit('["'), F.col("event_type"), F.lit('"]')))
    )
    raw = F.when(F.col("event_type") == "click", F.lit("inf")).otherwise(F.col("value").cast("string"))
    return t.raw("events").select(
        "event_id",
        F.array_join(tx.json_list(cell), "|").alias("items"),
        tx.finite_number(raw).alias("number"),
    )


@query(
    "film_url",
    "select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'N' then '' else 'https://films.example/s' || l_partkey end as url from lineitem",
)
def film_url(t):
    key = F.col("l_partkey").cast("string")
    film_key = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("ty:x:"), key)).otherwise(
        F.concat(F.lit("s"), key)
    )
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tx.film_url(film_key, "https://films.example/").alias("url")
    )


@query(
    "tv_as_movie",
    statement(
        """select tmdb_id as id, coalesce(title, '') as title, original_title, year || '-01-01' as release_date,
                  case when vote_count > 0 then popularity else 0 end as popularity from films where media_type = 'tv'""",
        "films",
    ),
)
def tv_as_movie(t):
    series = t.films().where(F.col("media_type") == "tv").select(
        F.col("tmdb_id").alias("id"),
        F.col("title").alias("name"),
        F.col("original_title").alias("original_name"),
        F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("first_air_date"),
        F.when(F.col("vote_count") > 0, F.col("popularity")).alias("popularity"),
    )
    return resolution.tv_as_movie(series)


_PAYLOAD_SQL = """select tmdb_id, '{media}' as media_type, imdb_id, title, original_title, original_language,
    release_date, year, runtime, status, false as adult, overview, tagline,
    array_to_string(genres, '|') as genres, array_to_string(keywords, '|') as keywords,
    array_to_string(production_countries, '|') as production_countries, '' as spoken_languages,
    vote_average, vote_count, popularity, {money} as budget, array_to_string(directors, '|') as directors,
    {writers} as writers, array_to_string(list_reverse("cast"), '|') as "cast"
    from (select *, year || '-03-01' as release_date from films where media_type = '{media}')"""


def _named(items):
    return F.transform(items, lambda v: F.struct(F.lit(1).alias("id"), v.alias("name")))


def _billing(items):
    # later entries are billed first
    return F.transform(
        items, lambda v, i: F.struct(F.lit(7).alias("id"), v.alias("name"), (F.lit(20) - i).alias("order"))
    )


def _flat_lists(frame):
    lists = ("genres", "keywords", "production_countries", "spoken_languages", "directors", "writers", "cast")
    keep = ("tmdb_id", "media_type", "imdb_id", "title", "original_title", "original_language", "release_date",
            "year", "runtime", "status", "adult", "overview", "tagline", "vote_average", "vote_count",
            "popularity", "budget")
    return frame.select(*keep, *[F.array_join(c, "|").alias(c) for c in lists])


@query(
    "normalize_movie",
    statement(_PAYLOAD_SQL.format(media="movie", money="vote_count", writers="directors[1] || '|' || tagline"), "films"),
)
def normalize_movie(t):
    films = t.films().where(F.col("media_type") == "movie")
    crew = F.array(
        F.struct(F.lit(3).alias("id"), F.col("directors")[0].alias("name"), F.lit("Director").alias("job"),
                 F.lit("Directing").alias("department")),
        F.struct(F.lit(4).alias("id"), F.col("directors")[0].alias("name"), F.lit("Novel").alias("job"),
                 F.lit("Crew").alias("department")),
        F.struct(F.lit(5).alias("id"), F.col("tagline").alias("name"), F.lit("Staff").alias("job"),
                 F.lit("Writing").alias("department")),
    )
    payload = F.to_json(
        F.struct(
            F.col("tmdb_id").alias("id"), "imdb_id", "title", "original_title", "original_language", "runtime",
            "status", "overview", "tagline", "vote_average", "vote_count", "popularity",
            F.concat(F.col("year").cast("string"), F.lit("-03-01")).alias("release_date"),
            F.col("vote_count").alias("budget"),
            _named(F.col("genres")).alias("genres"),
            F.struct(_named(F.col("keywords")).alias("keywords")).alias("keywords"),
            F.transform("production_countries", lambda c: F.struct(c.alias("iso_3166_1"))).alias("production_countries"),
            F.struct(_billing(F.col("cast")).alias("cast"), crew.alias("crew")).alias("credits"),
        )
    )
    return _flat_lists(payloads.normalize_movies(films.select(payload.alias("payload"))))


@query(
    "normalize_tv",
    statement(_PAYLOAD_SQL.format(media="tv", money="null::bigint", writers="''"), "films"),
)
def normalize_tv(t):
    series = t.films().where(F.col("media_type") == "tv")
    payload = F.to_json(
        F.struct(
            F.col("tmdb_id").alias("id"), F.col("title").alias("name"), F.col("original_title").alias("original_name"),
            "original_language", "status", "overview", "tagline", "vote_average", "vote_count", "popularity",
            F.struct("imdb_id").alias("external_ids"),
            F.concat(F.col("year").cast("string"), F.lit("-03-01")).alias("first_air_date"),
            F.array_compact(F.array("runtime")).alias("episode_run_time"),
            _named(F.col("genres")).alias("genres"),
            F.struct(_named(F.col("keywords")).alias("results")).alias("keywords"),
            F.transform("production_countries", lambda c: F.struct(c.alias("iso_3166_1"))).alias("production_countries"),
            _named(F.col("directors")).alias("created_by"),
            F.struct(_billing(F.col("cast")).alias("cast")).alias("aggregate_credits"),
        )
    )
    return _flat_lists(payloads.normalize_series(series.select(payload.alias("payload"))))


# -- catalogue and filters -----------------------------------------------------


@query("catalogue", statement("select tmdb_id, title, year, vote_count from catalogue", "catalogue"))
def catalogue(t):
    return t.catalogue().select("tmdb_id", "title", "year", "vote_count")


@query(
    "catalogue_drops",
    statement(
        """select count(*) filter (where trim(title) = '') as no_title,
                  count(*) filter (where trim(title) <> '' and status <> 'Released') as not_released,
                  count(*) filter (where trim(title) <> '' and status = 'Released') as kept,
                  round(count(*) filter (where trim(title) <> '' and status = 'Released')::double / count(*), 6) as kept_share
           from films where media_type = 'movie'""",
        "films",
    ),
)
def catalogue_drops(t):
    return cat.drop_counts(t.films()).select("no_title", "not_released", "kept", *r6("kept_share"))


@query(
    "catalogue_report",
    statement(
        f"""select {band_no('vote_count')} as band_no, {band('vote_count')} as band, count(*) as films,
                   round(count(*)::double / (select count(*) from catalogue), 6) as share
            from catalogue group by all""",
        "catalogue",
    ),
)
def catalogue_report(t):
    return cat.band_report(t.catalogue()).select("band_no", "band", "films", *r6("share"))


@query(
    "metadata_completeness",
    statement(
        f"""select {band_no('vote_count')} as band_no, {band('vote_count')} as band, count(*) as films,
                   round(avg((len(keywords) > 0)::int::double), 6) as keywords, round(avg((len("cast") > 0)::int::double), 6) as "cast",
                   round(avg((len(directors) > 0)::int::double), 6) as directors, round(avg((len(genres) > 0)::int::double), 6) as genres,
                   round(avg((trim(overview) <> '')::int::double), 6) as overview
            from catalogue group by all""",
        "catalogue",
    ),
)
def metadata_completeness(t):
    return cat.metadata_completeness(t.catalogue()).select(
        "band_no", "band", "films", *r6("keywords", "cast", "directors", "genres", "overview")
    )


@query(
    "merge_known",
    statement(
        """select tmdb_id, title, vote_count, true as enriched from films where media_type = 'movie' and keywords <> []
           union all
           select tmdb_id, title, vote_count, false from catalogue
           where tmdb_id not in (select tmdb_id from films where media_type = 'movie' and keywords <> [])""",
        "films",
        "catalogue",
    ),
)
def merge_known(t):
    enriched = t.films().where(F.size("keywords") > 0)
    return cat.overlay_enriched(t.catalogue().drop("keywords"), enriched).select(
        "tmdb_id", "title", "vote_count", "enriched"
    )


@query(
    "exclude_seen",
    statement(
        "select tmdb_id, title from catalogue where tmdb_id::varchar not in (select film_key from status where seen)",
        "catalogue",
        "status",
    ),
)
def exclude_seen(t):
    status = inter.film_status(t.interactions(), ["user_id", "film_key"])
    seen = status.where("seen").select(F.col("film_key").cast("long").alias("tmdb_id"))
    return cat.exclude_seen(t.catalogue(), seen).select("tmdb_id", "title")


@query(
    "min_support",
    statement(
        """select 'items20' as rule, count(*) as n from (select movieId from mr group by 1 having count(*) >= 20)
           union all select 'users40', count(*) from (select userId from mr group by 1 having count(*) >= 40)
           union all select 'cold5', count(*) from (select movieId from mr group by 1 having count(*) >= 5)""",
        "mr",
    ),
)
def min_support(t):
    from evenreel.operators.protocol import supported

    ratings = t.model_ratings()
    count = lambda rule, key, n: supported(ratings, key, n).agg(
        F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n")
    )
    return (
        count("items20", "movieId", 20)
        .unionByName(count("users40", "userId", 40))
        .unionByName(count("cold5", "movieId", 5))
    )


@query(
    "joined_view",
    statement("select user_id, film_key, tmdb_id, title, rating, seen, watchlist_pending, vote_count from joined", "joined"),
)
def joined_view(t):
    return _joined(t).select(
        "user_id", "film_key", "tmdb_id", "title", "rating", "seen", "watchlist_pending", "vote_count"
    )


def _joined(t):
    status = inter.film_status(t.interactions(), ["user_id", "film_key"])
    return inter.joined_view(status, t.film_map(), t.films())


# -- crowd chain -----------------------------------------------------------------


@query(
    "latest_snapshot",
    statement("select member, slug, rating, dump, count(*) as n from snapshot group by all", "snapshot"),
)
def latest_snapshot(t):
    return crowd.latest_snapshot(t.crowd()).groupBy("member", "slug", "rating", "dump").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "superseded",
    statement(
        """select dump, count(*) as members, count(*) filter (where seq < newest) as superseded
           from (select distinct member, dump, seq from crowd) join (select member, max(seq) as newest from crowd group by 1) using (member)
           group by dump""",
        "crowd",
    ),
)
def superseded(t):
    return crowd.superseded_members(t.crowd())


@query(
    "title_year_match",
    statement(
        """select t.slug, case when m.n = 1 then m.match_id end as tmdb_id,
                  case when m.n = 1 then 'title_year' when m.n > 1 then 'ambiguous' else 'unmatched' end as how
           from slug_table t left join slug_matches m on m.slug = t.slug where not t.live""",
        "slug_table",
        "slug_matches",
    ),
)
def title_year_match(t):
    """Slugs without a live link of their own, matched against the catalogue."""
    films = crowd.stack_in_order(t.dump_films())
    table = crowd.slug_map(films, t.catalogue(), t.live_ids())
    linked = table.where(F.col("how") == crowd.LINKED).select("slug")
    newest = films.groupBy("slug").agg(
        F.max_by(F.struct("title", "year"), "seq").alias("d")
    ).select("slug", "d.title", "d.year")
    return crowd.match_by_title_year(newest.join(linked, "slug", "left_anti"), t.catalogue())


def _slugs(t):
    return crowd.slug_map(crowd.stack_in_order(t.dump_films()), t.catalogue(), t.live_ids())


@query("slug_map", statement("select slug, title, year, tmdb_id, how from slugs", "slugs"))
def slug_map(t):
    return _slugs(t)


@query(
    "mapping_report",
    statement(
        """select how, count(*) as slugs, sum(raters)::bigint as ratings, count(*) filter (where raters >= 10) as pool_sized,
                  round(sum(raters)::double / (select sum(raters) from per_slug), 6) as share
           from (select p.raters, coalesce(s.how, 'no film record') as how from per_slug p left join slugs s using (slug))
           group by how""",
        "slugs",
        "per_slug",
        extra={
            "per_slug": (
                "select slug, count(distinct member) as raters from snapshot group by slug",
                ("snapshot",),
            )
        },
    ),
)
def mapping_report(t):
    report = crowd.mapping_report(crowd.latest_snapshot(t.crowd()), _slugs(t))
    return report.select("how", "slugs", "ratings", "pool_sized", *r6("share"))


def _by_film(t):
    return crowd.ratings_by_film(crowd.latest_snapshot(t.crowd()), _slugs(t))


def _written_by_size(t, build, label):
    """A table over the crowd's ratings, written by tasks of a size that the ratings do not change."""
    with sized_shuffles(t.spark, t.raw("lineitem").count()):  # a rating per line
        return written(build(), label)


def _pool(t):
    """Read several times by the reports, and far smaller than the ratings."""
    return _written_by_size(t, lambda: crowd.pool(_by_film(t), t.catalogue()), "pool")


@query("ratings_by_film", statement("select member, tmdb_id, rating, dump from by_film", "by_film"))
def ratings_by_film(t):
    return _written_by_size(t, lambda: _by_film(t), "by-film")


@query(
    "link_films",
    statement(
        """select m.film_key, m.tmdb_id, l.movieId, l.movieId is not null as in_archive
           from film_map m left join (select min(movieId) as movieId, tmdbId from links where tmdbId is not null group by tmdbId) l
             on l.tmdbId = m.tmdb_id where m.tmdb_id is not null""",
        "film_map",
        "links",
    ),
)
def link_films(t):
    return archive.link_films(t.film_map(), t.links()).select("film_key", "tmdb_id", "movieId", "in_archive")


@query("bridge", statement("select movieId, tmdb_id from bridge", "bridge"))
def bridge(t):
    return archive.bridge(t.links()).withColumnRenamed("tmdbId", "tmdb_id")


@query(
    "rekey_by_movie",
    statement("select b.movieId, f.vote_count from films f join bridge b using (tmdb_id)", "films", "bridge"),
)
def rekey_by_movie(t):
    return archive.by_movie_id(t.films().select("tmdb_id", "vote_count"), t.links()).select("movieId", "vote_count")


@query(
    "rated_ids",
    statement(
        "select distinct tmdbId::bigint as tmdb_id from links where tmdbId is not null and movieId - 500000 in (select movieId from mr_a)",
        "links",
        "mr_a",
    ),
)
def rated_ids(t):
    ratings = t.crowd_a().select((F.col("movieId") + 500000).alias("movieId"))
    return archive.rated_ids(t.links(), ratings)


@query("pool", statement("select tmdb_id, raters from pool", "pool"))
def pool(t):
    return _pool(t)


@query(
    "rated_elsewhere",
    statement(
        """select count(*) as rated_elsewhere from (select tmdb_id from by_film group by 1 having count(distinct member) >= 10)
           where tmdb_id not in (select tmdb_id from catalogue)""",
        "by_film",
        "catalogue",
    ),
)
def rated_elsewhere(t):
    return _written_by_size(t, lambda: crowd.rated_elsewhere(_by_film(t), t.catalogue()), "rated-elsewhere")


@query(
    "pool_summary",
    statement(
        """select count(*) as films, round(avg((l.tmdb_id is null)::int::double), 6) as cold_share,
                  round(quantile_cont(coalesce(c.vote_count, 0)::double, 0.5), 6) as median_votes,
                  count(*) filter (where coalesce(c.vote_count, 0) = 0) as zero_votes,
                  round(avg((coalesce(c.vote_count, 0) < 20)::int::double), 6) as under_20_share,
                  avg((l.tmdb_id is null)::int::double) between 0.25 and 0.46 as validated
           from catalogue c join pool p using (tmdb_id)
           left join (select distinct tmdbId::bigint as tmdb_id from links where tmdbId is not null) l using (tmdb_id)""",
        "catalogue",
        "pool",
        "links",
    ),
)
def pool_summary(t):
    known = archive.clean_links(t.links()).select(F.col("tmdbId").alias("tmdb_id"))
    summary = crowd.pool_summary(_pool(t), t.catalogue(), known)
    return summary.select(
        "films", *r6("cold_share", "median_votes"), "zero_votes", *r6("under_20_share"), "validated"
    )


@query(
    "pool_by_year",
    statement(
        """select y.year, coalesce(n, 0) as catalogue, coalesce(k, 0) as pool, round(k::double / n, 6) as share
           from (select unnest(generate_series(1940, 2005))::integer as year) y
           left join (select c.year, count(*) as n, count(p.tmdb_id) as k from catalogue c left join pool p using (tmdb_id) group by 1) g
             on g.year = y.year""",
        "catalogue",
        "pool",
    ),
)
def pool_by_year(t):
    report = crowd.pool_by_year(_pool(t), t.catalogue(), 1940, 2005)
    return report.select("year", "catalogue", "pool", *r6("share"))


@query(
    "model_ratings",
    statement(
        """select dense_rank() over (order by md5(member), member)::integer - 1 as userId, tmdb_id as movieId,
                  rating::double / 2 as rating from by_film""",
        "by_film",
    ),
)
def model_ratings(t):
    return crowd.as_model_ratings(_by_film(t))


# -- resolution --------------------------------------------------------------------

_QUERY_TITLE = "case when p_type = 'ECONOMY' then 'The ' || p_name || ' ' || p_brand else p_name || ' ' || p_brand end"
_QUERY_YEAR = "case p_type when 'LARGE' then p_size + 1951 when 'SMALL' then null else p_size + 1950 end"


_ASKED = {
    "asked": (f"select 's' || p_partkey as film_key, {_QUERY_TITLE} as title, {_QUERY_YEAR} as year from part", ()),
}


def _asked_films(t):
    return t.raw("part").select(
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("film_key"),
        F.expr(_QUERY_TITLE).alias("title"),
        F.expr(_QUERY_YEAR).alias("year"),
    )


def _search_hits(t):
    """One search hit per order line: the line's part asks, a supplier-numbered part answers.

    Beside them every film's own record under a changed title.
    """
    films = t.films().select(
        F.col("tmdb_id").alias("id"),
        F.col("title").alias("candidate_title"),
        F.col("original_title").alias("candidate_original"),
        F.concat(F.col("year").cast("string"), F.lit("-07-01")).alias("release_date"),
        "popularity",
        "media_type",
    )
    asked = _asked_films(t)
    pairs = t.raw("lineitem").select(
        F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("film_key"),
        F.col("l_suppkey").alias("id"),
    ).distinct()
    lines = pairs.join(films, "id")
    misspelt = F.when(
        F.col("media_type") == "tv", F.regexp_replace("candidate_title", "e", "")
    ).otherwise(F.concat(F.lit("The "), F.col("candidate_title")))
    own = films.withColumn("candidate_title", misspelt).withColumn(
        "film_key", F.concat(F.lit("s"), F.col("id").cast("string"))
    )
    return asked.join(own.unionByName(lines), "film_key")


def _lcs(a: str, b: str) -> str:
    """Longest common subsequence of code points: a table row per code point of ``b`` (a list of lists)."""
    better = f"list_transform({a}[1:j], lambda y, k: case when y = c[1] then coalesce(p[k - 1], 0) + 1 else p[k] end)"
    line = f"list_transform({a}, lambda x, j: list_max({better}))"
    return f"list_last(list_reduce({b}, lambda p, c: {line}, list_transform({a}, lambda x: 0)))"


_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_FULL = norm("p_name || ' ' || p_brand")


@query(
    "title_similarity",
    f"""with forms as (
          select p_partkey, unnest({variants('f')}) as l, t, regexp_replace(f, '[aeiou]', '', 'g') as d
          from (select p_partkey, {_FULL} as f, {norm("p_brand || ' ' || p_name")} as t from part)
        ), pairs as (select l, t as r from forms union select l, d from forms
        ), orders as (select l, r, l as a, r as b from pairs
          union all select l, r, {_SORTED.format('l')}, {_SORTED.format('r')} from pairs
        ), points as (
          select l, r, list_transform(string_split(a, ''), lambda x: unicode(x)) as a,
                 list_transform(string_split(b, ''), lambda x: [unicode(x)]) as b from orders
        ), scores as (select l, r, max(200.0::double * {_lcs('a', 'b')} / (len(a) + len(b))) as s from points group by l, r)
        select p_partkey, max(x.s) as reordered, round(max(y.s), 6) as no_vowels
        from forms f join scores x on x.l = f.l and x.r = f.t join scores y on y.l = f.l and y.r = f.d group by p_partkey""",
)
def title_similarity(t):
    """Best similarity of each film's title and its original, misspelt and reordered forms."""
    full = tx.normalize_title(F.concat("p_name", F.lit(" "), "p_brand"))
    turned = tx.normalize_title(F.concat("p_brand", F.lit(" "), "p_name"))
    dropped = F.regexp_replace(full, "[aeiou]", "")
    return t.raw("part").select(
        "p_partkey",
        tx.title_similarity(tx.title_variants(full), F.array(turned)).alias("reordered"),
        F.round(tx.title_similarity(tx.title_variants(full), F.array(dropped)), 6).alias("no_vowels"),
    )


def _tiers_sql(pairs: str, out: str) -> dict:
    """Views of the best acceptable record per film among given pairs of both.

    Columns of the pairs: film_key, query, year, id, media_type, title, original,
    candidate_year and popularity; both titles as they stand.
    """
    own, other = f"{out}_pairs", f"{out}_scores"
    literals = f"list_distinct([{norm('title')}, {norm('original')}])"
    forms = f"list_distinct(flatten(list_transform(list_filter({literals}, lambda t: t <> ''), lambda t: {variants('t')})))"
    marks = f"list_transform(forms, lambda f: coalesce({marker('f')}, ''))"
    return {
        own: (
            f"""select *, list_contains(literals, query) as lit, len(list_intersect(query_forms, forms)) > 0 as same
                from (select *, abs(candidate_year - year) as delta, {literals} as literals, {forms} as forms,
                             {variants('query')} as query_forms from {pairs})
                where delta <= 2 and list_contains({marks}, coalesce({marker('query')}, ''))""",
            (pairs,),
        ),
        other: (
            f"""select l, r, max(case when a = [] or b = [] then 0 else 200.0::double * {_lcs('a', 'b')} / (len(a) + len(b)) end) as s
                from (select l, r, list_transform(string_split(x, ''), lambda c: unicode(c)) as a,
                             list_transform(string_split(y, ''), lambda c: [unicode(c)]) as b
                      from (with texts as (select distinct l, unnest(forms) as r from (select forms, unnest(query_forms) as l from {own}))
                            select l, r, l as x, r as y from texts
                            union all select l, r, {_SORTED.format('l')}, {_SORTED.format('r')} from texts))
                group by l, r""",
            (own,),
        ),
        out: (
            f"""select film_key, id as tmdb_id, media_type, coalesce(nullif(title, ''), original, '') as tmdb_title,
                       candidate_year as tmdb_year, ['medium', 'high', 'exact'][tier] as confidence, score as title_score,
                       delta as year_delta
                from (select *, case when delta <= 1 and same then 3 when delta <= 1 and score >= 90 then 2 when score >= 85 then 1 end as tier
                      from (select film_key, id, media_type, title, original, candidate_year, delta, same, lit, popularity, max(s) as score
                            from (select *, unnest(forms) as r from (select *, unnest(query_forms) as l from {own}))
                            join {other} using (l, r) group by all))
                where tier is not null
                qualify row_number() over (partition by film_key order by tier desc, media_type = 'movie' desc, lit desc, score desc,
                                                    popularity desc, id) = 1""",
            (own, other),
        ),
    }


_RECORD = """f.tmdb_id as id, f.media_type, f.original_title as original, f.year as candidate_year, f.popularity"""
_HITS = {
    **_ASKED,
    "hit_list": (
        f"""select a.film_key, {norm("a.title")} as query, a.year, {_RECORD}, f.title
            from (select distinct l_partkey, l_suppkey from lineitem) x join films f on f.tmdb_id = x.l_suppkey
            join asked a on a.film_key = 's' || x.l_partkey
            union all
            select a.film_key, {norm("a.title")}, a.year, {_RECORD},
                   case f.media_type when 'tv' then replace(f.title, 'e', '') else 'The ' || f.title end
            from films f join asked a on a.film_key = 's' || f.tmdb_id""",
        ("films", "asked"),
    ),
    **_tiers_sql("hit_list", "chosen"),
}


@query(
    "resolve_candidates",
    statement("select * replace (round(title_score, 6) as title_score) from chosen", "chosen", extra=_HITS),
)
def resolve_candidates(t):
    return resolution.resolve_candidates(_search_hits(t)).withColumn(
        "title_score", F.round("title_score", 6)
    )


def _exact_sql(catalogue: str) -> str:
    marks = f"({marker('query')}) is not distinct from ({marker('v.form')})"
    return f"""select q.film_key, b.tmdb_id, b.delta as year_delta,
                  case when b.tmdb_id is not null then 'exact' else 'unresolved' end as confidence
           from asked q left join (
             select film_key, tmdb_id, delta from (
               select a.film_key, c.tmdb_id, abs(c.year - a.year) as delta, c.popularity, c.literal = a.query as lit
               from (select film_key, year, {norm("title")} as query, unnest({variants(norm("title"))}) as form from asked where year is not null) a
               join (select tmdb_id, year, popularity, {norm("title")} as literal, unnest({variants(norm("title"))}) as form
                     from (select tmdb_id, year, popularity, title from {catalogue} union all
                           select tmdb_id, year, popularity, original_title from {catalogue}) where {norm("title")} <> '') c
                 on c.form = a.form and abs(c.year - a.year) <= 1
               where exists (select 1 from (select unnest({variants("c.literal")}) as form) v where {marks.replace("query", "a.query")}))
             qualify row_number() over (partition by film_key order by lit desc, popularity desc, tmdb_id) = 1) b
           on b.film_key = q.film_key"""


@query("resolve_exact", statement(_exact_sql("catalogue"), "catalogue", "asked", extra=_ASKED))
def resolve_exact(t):
    return resolution.resolve_exact(_asked_films(t), t.catalogue())


_SPACES = {
    **_ASKED,
    "film_hits": (_exact_sql("catalogue"), ("catalogue", "asked")),
    "series": ("select * from films where media_type = 'tv'", ("films",)),
    "series_hits": (_exact_sql("series"), ("series", "asked")),
}


@query(
    "resolve_namespaces",
    statement(
        """select f.film_key, coalesce(f.tmdb_id, s.tmdb_id) as tmdb_id,
                  case when f.tmdb_id is not null or s.tmdb_id is not null then 'exact' else 'unresolved' end as confidence,
                  case when f.tmdb_id is not null then 'movie' when s.tmdb_id is not null then 'tv' end as media_type
           from film_hits f join series_hits s using (film_key)""",
        "film_hits",
        "series_hits",
        extra=_SPACES,
    ),
)
def resolve_namespaces(t):
    asked = _asked_films(t)
    series = t.films().where(F.col("media_type") == "tv")
    columns = ("film_key", "tmdb_id", "confidence")
    return resolution.choose_namespace(
        resolution.resolve_exact(asked, t.catalogue()).select(*columns),
        resolution.resolve_exact(asked, series).select(*columns),
    )


@query(
    "overrides_latest",
    statement("select film_key, tmdb_id, media_type from latest_overrides", "latest_overrides"),
)
def overrides_latest(t):
    return resolution.latest_overrides(t.overrides())


@query(
    "overrides_fresh",
    """select (c_custkey * 2)::varchar as film_key, c_name as note from customer
       where c_custkey * 2 not in (select o_custkey from orders)""",
)
def overrides_fresh(t):
    reviewed = t.raw("customer").select(
        (F.col("c_custkey") * 2).cast("string").alias("film_key"), F.col("c_name").alias("note")
    )
    recorded = t.overrides().select(F.trim("film_key").alias("film_key"))
    return resolution.fresh_overrides(reviewed, recorded)


@query(
    "overrides_append",
    statement(
        """select film_key, tmdb_id, media_type from latest_overrides
           union all
           select (c_custkey * 2)::varchar, case when c_custkey % 3 > 0 then c_custkey end, 'tv' from customer
           where c_custkey * 2 not in (select o_custkey from orders)""",
        "latest_overrides",
    ),
)
def overrides_append(t):
    """A review written behind the recorded overrides, and written again to no effect."""
    path = scratch_path(t.spark, "overrides")
    t.overrides().write.parquet(path)
    customer = F.col("c_custkey")
    review = t.raw("customer").select(
        (customer * 2).cast("string").alias("film_key"),
        F.when(customer % 3 > 0, customer.cast("string")).otherwise("").alias("tmdb_id"),
        F.lit("tv").alias("media_type"),
        F.col("c_name").alias("title"),
        F.lit("seen").alias("note"),
    )
    for _ in range(2):
        recorded = store.append_overrides(resolution.reviewed_rows(review), path)
    return resolution.latest_overrides(recorded)


_BATCH = {
    **_ASKED,
    "film_hits": (_exact_sql("catalogue"), ("catalogue", "asked")),
    "fixes": (
        "select 's' || film_key as film_key, tmdb_id, media_type from latest_overrides",
        ("latest_overrides",),
    ),
}


@query(
    "resolve_batch",
    statement(
        """select a.film_key, a.title, a.year,
                  case when o.film_key is not null then o.tmdb_id else h.tmdb_id end as tmdb_id,
                  case when o.film_key is not null then case when o.tmdb_id is not null then o.media_type end
                       when h.tmdb_id is not null then 'movie' end as media_type,
                  case when o.film_key is not null then case when o.tmdb_id is not null then 'override' else 'unresolved' end
                       else h.confidence end as confidence,
                  case when o.film_key is not null then 'override' else 'auto' end as source
           from asked a left join fixes o using (film_key) left join film_hits h on h.film_key = a.film_key""",
        "fixes",
        "film_hits",
        extra=_BATCH,
    ),
)
def resolve_batch(t):
    asked = _asked_films(t)
    fixes = resolution.latest_overrides(t.overrides()).withColumn(
        "film_key", F.concat(F.lit("s"), "film_key")
    )
    hits = resolution.resolve_exact(asked, t.catalogue()).select(
        "film_key",
        "tmdb_id",
        F.when(F.col("tmdb_id").isNotNull(), "movie").alias("media_type"),
        F.lit("").alias("tmdb_title"),
        F.lit(None).cast("int").alias("tmdb_year"),
        "confidence",
        F.lit(None).cast("double").alias("title_score"),
        "year_delta",
    )
    return resolution.resolve_batch(asked, fixes, hits).select(
        "film_key", "title", "year", "tmdb_id", "media_type", "confidence", "source"
    )


_TYPO = """case p_type when 'ECONOMY' then 'The ' || p_name || ' ' || p_brand
    when 'MEDIUM' then replace(p_name, 'e', '') || ' ' || p_brand
    when 'STANDARD' then split_part(p_name, ' ', 2) || 's ' || split_part(p_name, ' ', 1) || ' ' || p_brand
    when 'PROMO' then replace(p_name, 'l', 'll') || ' - ' || p_brand
    else p_name || ' ' || p_brand end"""
_TYPO_YEAR = "case when p_size = 7 then null when p_type in ('LARGE', 'PROMO') then p_size + 1952 else p_size + 1951 end"
_FUZZY = {
    "typos": (f"select 's' || p_partkey as film_key, {_TYPO} as title, {_TYPO_YEAR} as year from part", ()),
    "all_hits": (
        f"""select a.film_key, {norm("a.title")} as query, a.year, {_RECORD}, f.title
            from typos a join films f on abs(f.year - a.year) <= 2""",
        ("films", "typos"),
    ),
    **_tiers_sql("all_hits", "fuzzy"),
    "fixes": _BATCH["fixes"],
}


def _misspelt_films(t):
    return t.raw("part").select(
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("film_key"),
        F.expr(_TYPO).alias("title"),
        F.expr(_TYPO_YEAR).alias("year"),
    )


@query(
    "resolve_fuzzy",
    statement("select * replace (round(title_score, 6) as title_score) from fuzzy", "fuzzy", extra=_FUZZY),
)
def resolve_fuzzy(t):
    """Misspelt titles against every film and series; the SQL scores all pairs of near years."""
    return retrieval.resolve_catalogue(_misspelt_films(t), t.films()).withColumn(
        "title_score", F.round("title_score", 6)
    )


@query(
    "resolve_batch_fuzzy",
    statement(
        """select a.film_key, a.title, a.year,
                  case when o.film_key is not null then o.tmdb_id else h.tmdb_id end as tmdb_id,
                  case when o.film_key is null then h.media_type when o.tmdb_id is not null then o.media_type end as media_type,
                  case when o.film_key is null then coalesce(h.tmdb_title, '') else '' end as tmdb_title,
                  case when o.film_key is null then h.tmdb_year end as tmdb_year,
                  case when o.film_key is null then coalesce(h.confidence, 'unresolved')
                       when o.tmdb_id is not null then 'override' else 'unresolved' end as confidence,
                  case when o.film_key is null then round(coalesce(h.title_score, 0.0::double), 6) end as title_score,
                  case when o.film_key is null then h.year_delta end as year_delta,
                  case when o.film_key is not null then 'override' else 'auto' end as source
           from typos a left join fixes o using (film_key) left join fuzzy h on h.film_key = a.film_key""",
        "typos",
        "fixes",
        "fuzzy",
        extra=_FUZZY,
    ),
)
def resolve_batch_fuzzy(t):
    """The film map with all tiers over the whole catalogue."""
    asked = _misspelt_films(t)
    fixes = resolution.latest_overrides(t.overrides()).withColumn(
        "film_key", F.concat(F.lit("s"), "film_key")
    )
    film_map = resolution.resolve_batch(asked, fixes, retrieval.resolve_catalogue(asked, t.films()))
    return film_map.withColumn("title_score", F.round("title_score", 6))


@query(
    "review_queue",
    statement(
        "select film_key, title, tmdb_id, confidence from film_map where confidence in ('unresolved', 'medium') and source <> 'override'",
        "film_map",
    ),
)
def review_queue(t):
    return resolution.pending_review(t.film_map()).select("film_key", "title", "tmdb_id", "confidence")


@query(
    "trusted_map",
    statement(
        "select confidence, count(*) as films from film_map where confidence in ('exact', 'high', 'override') group by 1",
        "film_map",
    ),
)
def trusted_map(t):
    return resolution.trusted(t.film_map()).groupBy("confidence").agg(F.count(F.lit(1)).alias("films"))


@query(
    "review_table",
    statement(
        """select m.film_key, m.title, m.year, 'https://films.example/' || m.film_key as url,
                  case when m.tmdb_id is not null then m.tmdb_id || ' | ' || m.tmdb_title || ' (' || m.tmdb_year || ') [' || m.confidence || ', ' || m.media_type || ']' else '' end as auto_match,
                  coalesce(max(case when r = 1 then label end), '') as suggestion_1,
                  coalesce(max(case when r = 2 then label end), '') as suggestion_2,
                  coalesce(max(case when r = 3 then label end), '') as suggestion_3
           from film_map m left join (
             select film_key, label, row_number() over (partition by film_key order by position, id) as r from hits) h
             on h.film_key = m.film_key and r <= 3
           where m.confidence in ('unresolved', 'medium') and m.source <> 'override' group by all""",
        "film_map",
        "hits",
        extra={
            "hits": (
                """select l_partkey::varchar as film_key, l_orderkey * 100 + l_linenumber as position, l_suppkey as id,
                          l_suppkey || ' | ' || s_name || ' (' || case when l_returnflag = 'N' then '????' else year(l_shipdate)::varchar end || ')' as label
                   from lineitem join supplier on s_suppkey = l_suppkey""",
                (),
            )
        },
    ),
)
def review_table(t):
    hits = t.raw("lineitem").join(t.raw("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.col("l_partkey").cast("string").alias("film_key"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("position"),
        F.col("l_suppkey").alias("id"),
        F.col("s_name").alias("candidate_title"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("release_date"),
    )
    table = resolution.review_table(t.film_map(), hits, url_base="https://films.example")
    return table.select(
        "film_key", "title", "year", "url", "auto_match", "suggestion_1", "suggestion_2", "suggestion_3"
    )


@query(
    "reviewed_rows",
    """select trim(o_orderkey::varchar) as film_key, case when o_orderpriority = '5-LOW' then '' else o_custkey::varchar end as tmdb_id,
              case when o_orderpriority = '2-HIGH' then 'tv' else 'movie' end as media_type,
              case when o_orderstatus = 'F' then 'no such film' else '' end as note
       from orders where o_orderpriority <> '5-LOW' or o_orderstatus = 'F'""",
)
def reviewed_rows(t):
    kind = F.col("o_orderpriority")
    review = t.raw("orders").select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("film_key"),
        F.when(kind == "5-LOW", " ").otherwise(F.col("o_custkey").cast("string")).alias("tmdb_id"),
        F.when(kind == "2-HIGH", " TV").when(kind == "3-MEDIUM", "disc").alias("media_type"),
        F.lit("x").alias("title"),
        F.when(F.col("o_orderstatus") == "F", " no such film ").alias("note"),
    )
    return resolution.reviewed_rows(review).select("film_key", "tmdb_id", "media_type", "note")


@query(
    "confidence_counts",
    statement(
        "select confidence, count(*) as films, round(count(*)::double / (select count(*) from film_map), 6) as share from film_map group by 1",
        "film_map",
    ),
)
def confidence_counts(t):
    return resolution.confidence_counts(t.film_map()).select("confidence", "films", *r6("share"))


@query(
    "duplicate_ids",
    statement(
        """select tmdb_id, film_key, title from film_map where tmdb_id is not null
           qualify count(*) over (partition by tmdb_id) > 1""",
        "film_map",
    ),
)
def duplicate_ids(t):
    return resolution.duplicate_ids(t.film_map()).select("tmdb_id", "film_key", "title")


@query(
    "known_films",
    statement(
        """select film_key, title, year from (select user_id, film_key, title, year from status)
           qualify row_number() over (partition by film_key order by user_id, title) = 1""",
        "status",
    ),
)
def known_films(t):
    per_user = inter.films_local(t.interactions(), ["user_id", "film_key"])
    return inter.known_films(per_user)
