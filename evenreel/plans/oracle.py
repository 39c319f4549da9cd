"""The views of ``views.py`` in SQL, composed into self-contained statements."""

from __future__ import annotations

from evenreel.functions.text import ARTICLES, ROMAN_NUMERALS


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def norm(text: str) -> str:
    """normalize_title over Latin text."""
    bare = f"replace(lower(strip_accents(coalesce({text}, ''))), 'ß', 'ss')"
    return (
        f"trim(regexp_replace(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), "
        "'\\s+', ' ', 'g'))"
    )


def variants(n: str) -> str:
    words = f"string_split({n}, ' ')"
    arts = _list(ARTICLES)
    return (
        f"list_distinct(list_filter([{n}, "
        f"case when len({words}) > 1 and list_contains({arts}, {words}[1]) "
        f"then array_to_string({words}[2:], ' ') end, "
        f"case when len({words}) > 1 and list_contains({arts}, {words}[-1]) "
        f"then array_to_string({words}[:-2], ' ') end], lambda x: x is not null))"
    )


def marker(n: str) -> str:
    words = f"string_split({n}, ' ')"
    return (
        f"case when len({words}) > 1 and (regexp_full_match({words}[-1], '\\d+') "
        f"or list_contains({_list(ROMAN_NUMERALS)}, {words}[-1])) then {words}[-1] end"
    )


def band_no(votes: str) -> str:
    v = f"coalesce({votes}, 0)"
    return (
        f"(1 + case when {v} > 0.5 then 1 else 0 end + case when {v} > 4.5 then 1 else 0 end "
        f"+ case when {v} > 19.5 then 1 else 0 end + case when {v} > 99.5 then 1 else 0 end "
        f"+ case when {v} > 499.5 then 1 else 0 end + case when {v} > 1999.5 then 1 else 0 end "
        f"+ case when {v} > 9999.5 then 1 else 0 end)"
    )


def band(votes: str) -> str:
    labels = "['0','1-4','5-19','20-99','100-499','500-2k','2k-10k','10k+']"
    return f"{labels}[{band_no(votes)}]"


def spearman(source: str, by: str, left: str, right: str, out: str) -> str:
    """Body of a CTE: rank correlation per group with shared ranks for ties."""
    keys = f"partition by {by}" if by else ""
    part = f"{by}, " if by else ""
    same = lambda c: f"count(*) over (partition by {part}{c})"
    group = f"group by {by}" if by else ""
    return f"""
      select {part}case when count(*) >= 3 and stddev_pop(l) > 0 and stddev_pop(r) > 0
             then corr(l, r) end as {out}
      from (select {part}
                   rank() over ({keys} order by {left}) + ({same(left)} - 1) / 2.0::double as l,
                   rank() over ({keys} order by {right}) + ({same(right)} - 1) / 2.0::double as r
            from {source} where {left} is not null and {right} is not null)
      {group}"""


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ratings10": (
        """select o_custkey as member, l_partkey as item, cast(ceil(l_quantity / 5) as integer) as rating,
                  case when o_orderdate < timestamp '1998-01-01' then 0 else 1 end as seq,
                  case when o_orderdate < timestamp '1998-01-01' then 'old' else 'new' end as dump,
                  l_returnflag as flag
           from lineitem join orders on l_orderkey = o_orderkey""",
        (),
    ),
    "crowd": (
        "select 'm' || member as member, 's' || item as slug, rating, dump, seq from ratings10",
        ("ratings10",),
    ),
    "mr": (
        """select member as userId, item as movieId, round_even(avg(rating), 0)::double / 2 as rating
           from ratings10 group by all""",
        ("ratings10",),
    ),
    "mr_a": (
        """select member as userId, item as movieId, round_even(avg(rating), 0)::double / 2 as rating
           from ratings10 where flag in ('A', 'R') group by all""",
        ("ratings10",),
    ),
    "mr_b": (
        """select member as userId, item as movieId, round_even(avg(rating), 0)::double / 2 as rating
           from ratings10 where flag = 'N' group by all""",
        ("ratings10",),
    ),
    "films": (
        """select p_partkey as tmdb_id, case when p_type = 'MEDIUM' then 'tv' else 'movie' end as media_type,
                  'tt' || lpad(p_partkey::varchar, greatest(7, length(p_partkey::varchar))::integer, '0') as imdb_id,
                  case when p_type = 'SMALL' and p_size > 45 then '' else p_name || ' ' || p_brand end as title,
                  p_name as original_title, lower(substr(p_type, 1, 2)) as original_language,
                  p_size + 1950 as year, case when p_size >= 5 then p_size * 2 + 60 end as runtime,
                  case when p_type = 'PROMO' and p_size > 40 then 'Planned' else 'Released' end as status,
                  p_name || ' by ' || p_brand as overview, lower(p_type) as tagline,
                  [p_type] as genres,
                  case when p_size >= 10 then string_split(p_name, ' ') else [] end as keywords,
                  case when p_size >= 25 then [p_brand || ' Star', p_name] else [] end as "cast",
                  [p_brand] as directors, [substr(p_type, 1, 2)] as production_countries,
                  (cast(round((p_retailprice - 900) * 10) as bigint)
                   * cast(round((p_retailprice - 900) * 10) as bigint)) // 50 as vote_count,
                  (cast(round((p_retailprice - 900) * 10) as bigint) % 91)::double / 10 as vote_average,
                  p_retailprice as popularity
           from part""",
        (),
    ),
    "catalogue": (
        "select * from films where media_type = 'movie' and trim(title) <> '' and status = 'Released'",
        ("films",),
    ),
    "rated": (
        """select movieId, userId, rating, title, year, genres, directors, vote_count, vote_average
           from mr join films on movieId = tmdb_id""",
        ("mr", "films"),
    ),
    "house": (
        """select f.*, m.rating from films f
           join (select movieId, avg(rating) as rating from mr group by 1) m on m.movieId = f.tmdb_id""",
        ("mr", "films"),
    ),
    "links": (
        """select p_partkey + 500000 as movieId, p_partkey as imdbId,
                  cast(case when p_type = 'PROMO' then null when p_type = 'LARGE' then p_size
                       else p_partkey end as double) as tmdbId from part""",
        (),
    ),
    "bridge": (
        """select min(movieId) as movieId, tmdbId::bigint as tmdb_id from links
           where tmdbId is not null group by tmdbId""",
        ("links",),
    ),
    "vectors": (
        "select vec_id as movieId, embedding::double[] as vec from embeddings",
        (),
    ),
    "unit_vecs": (
        """select movieId, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-8)) as vec
           from vectors""",
        ("vectors",),
    ),
    "labelled": (
        "select vec_id as row, (label + 1)::double / 2 as rating, embedding::double[] as vec from embeddings",
        (),
    ),
    "dump_films": (
        """select 's' || p_partkey as slug,
                  case when p_type not in ('PROMO', 'SMALL') then p_partkey end as tmdb_id,
                  p_name || ' ' || p_brand as title, p_size + 1950 as year, 0 as seq
           from part where p_type <> 'LARGE'
           union all
           select 's' || p_partkey, null, upper(p_name || ', ' || p_brand), p_size + 1950, 1
           from part where p_type <> 'ECONOMY'""",
        (),
    ),
    "cat_forms": (
        f"""select distinct tmdb_id, year, {norm("t")} as form
            from (select tmdb_id, year, title as t from catalogue
                  union all select tmdb_id, year, original_title from catalogue)
            where {norm("t")} <> ''""",
        ("catalogue",),
    ),
    "slug_table": (
        """select d.slug, d.title, d.year, l.tmdb_id,
                  l.tmdb_id is not null and l.tmdb_id in (select tmdb_id from films where media_type = 'movie') as live
           from (select * from dump_films
                 qualify row_number() over (partition by slug order by seq desc) = 1) d
           left join (select * from dump_films where tmdb_id is not null
                      qualify row_number() over (partition by slug order by seq) = 1) l on l.slug = d.slug""",
        ("dump_films", "films"),
    ),
    "slug_matches": (
        f"""select slug, min(tmdb_id) as match_id, count(distinct tmdb_id) as n
            from (select q.slug, c.tmdb_id, abs(q.year - c.year) as delta,
                         min(abs(q.year - c.year)) over (partition by q.slug) as best
                  from (select slug, year, {norm("title")} as form from slug_table where not live) q
                  join cat_forms c on c.form = q.form and abs(q.year - c.year) <= 1)
            where delta = best group by slug""",
        ("slug_table", "cat_forms"),
    ),
    "slugs": (
        """select slug, title, year, tmdb_id, 'linked' as how from slug_table where live
           union all
           select t.slug, t.title, t.year, case when m.n = 1 then m.match_id end,
                  case when m.n = 1 then 'title_year' when m.n > 1 then 'ambiguous'
                       when t.tmdb_id is not null then 'dead link' else 'unmatched' end
           from slug_table t left join slug_matches m on m.slug = t.slug where not t.live""",
        ("slug_table", "slug_matches"),
    ),
    "snapshot": (
        """select c.* from crowd c
           join (select member, max(seq) as seq from crowd group by 1) n using (member, seq)""",
        ("crowd",),
    ),
    "by_film": (
        """select member, tmdb_id, round_even(avg(rating), 0)::integer as rating, max_by(dump, seq) as dump
           from snapshot join slugs using (slug) where tmdb_id is not null group by member, tmdb_id""",
        ("snapshot", "slugs"),
    ),
    "pool": (
        """select tmdb_id, count(distinct member) as raters from by_film
           where tmdb_id in (select tmdb_id from catalogue)
           group by 1 having count(distinct member) >= 10""",
        ("by_film", "catalogue"),
    ),
    "inter": (
        """select user_id, film_key, case when kind in ('watched', 'like') then lower(name) else name end as title,
                  year, kind,
                  case when kind in ('rating', 'diary') then least(5.0::double, greatest(0.5::double, ceil(value / 10) / 2)) end as value,
                  ts as event_date, case when kind = 'diary' then ts end as watched_date, value > 100 as deleted
           from (select user_id, json_extract_string(props, '$.k') as film_key, value, ts,
                        case event_type when 'purchase' then 'rating' when 'view' then 'watched'
                             when 'click' then 'watchlist' when 'signup' then 'like' else 'diary' end as kind
                 from events)
           join (select p_partkey::varchar as film_key, p_name || ' ' || p_brand as name, p_size + 1950 as year
                 from part) using (film_key)""",
        (),
    ),
    "film_names": (
        """select user_id, film_key, title from (
             select user_id, film_key, title, count(*) as n from inter group by all)
           qualify row_number() over (partition by user_id, film_key order by n desc, title) = 1""",
        ("inter",),
    ),
    "status": (
        """select i.user_id, i.film_key, any_value(n.title) as title, min(i.year) as year,
                  bool_or(kind in ('watched', 'rating', 'diary')) as seen,
                  coalesce(arg_min(value, struct_pack(a := event_date, b := value)) filter (where kind = 'rating'),
                           arg_max(value, struct_pack(a := watched_date, b := event_date, c := value))
                             filter (where kind = 'diary' and value is not null)) as rating,
                  bool_or(kind = 'like') as liked, bool_or(kind = 'watchlist') as on_watchlist,
                  bool_or(kind = 'watchlist') and not bool_or(kind in ('watched', 'rating', 'diary')) as watchlist_pending
           from inter i join film_names n on n.user_id = i.user_id and n.film_key = i.film_key
           group by i.user_id, i.film_key""",
        ("inter", "film_names"),
    ),
    "film_map": (
        """select p_partkey::varchar as film_key, p_name || ' ' || p_brand as title, p_size + 1950 as year,
                  cast(case when p_type = 'SMALL' then null when p_type = 'ECONOMY' then p_size else p_partkey end as bigint) as tmdb_id,
                  case when p_type = 'SMALL' then null when p_type = 'MEDIUM' then 'tv' else 'movie' end as media_type,
                  case when p_type = 'SMALL' then '' else p_name end as tmdb_title,
                  case when p_type <> 'SMALL' then p_size + 1950 end as tmdb_year,
                  case p_type when 'SMALL' then 'unresolved' when 'MEDIUM' then 'medium' when 'ECONOMY' then 'high'
                       when 'PROMO' then 'override' else 'exact' end as confidence,
                  case when p_type = 'PROMO' then 'override' else 'auto' end as source
           from part""",
        (),
    ),
    "joined": (
        """select s.*, f.tmdb_id, f.genres, f.directors, f.vote_count, f.vote_average
           from status s join film_map m on m.film_key = s.film_key and m.tmdb_id is not null
           join films f on f.tmdb_id = m.tmdb_id and f.media_type = 'movie'""",
        ("status", "film_map", "films"),
    ),
    "overrides": (
        """select ' ' || o_custkey as film_key,
                  case o_orderpriority when '5-LOW' then '' when '1-URGENT' then 'n/a' else o_orderkey::varchar end as tmdb_id,
                  case o_orderpriority when '2-HIGH' then ' TV ' when '3-MEDIUM' then 'disc' else 'movie' end as media_type,
                  o_orderkey as seq from orders""",
        (),
    ),
    "latest_overrides": (
        """select trim(film_key) as film_key, try_cast(trim(tmdb_id) as bigint) as tmdb_id,
                  case when lower(trim(media_type)) in ('movie', 'tv') then lower(trim(media_type)) else 'movie' end as media_type
           from overrides qualify row_number() over (partition by trim(film_key) order by seq desc) = 1""",
        ("overrides",),
    ),
}


def statement(body: str, *views: str, extra: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> str:
    """``with`` clause of the views a query needs, dependencies first."""
    known = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in known[name][1]:
            visit(needed)
        ordered.append(name)

    for view in views:
        visit(view)
    if not ordered:
        return body
    # views read several times are computed once
    clauses = ",\n".join(f"{n} as materialized ({known[n][0]})" for n in ordered)
    return f"with {clauses}\n{body}"
