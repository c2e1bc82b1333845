"""SQL for DuckDB that gives the rows of the registered library queries, written from what they mean."""

from __future__ import annotations

from lumenary.functions import imaging, lenient_json, providers
from lumenary.plans import request
from lumenary.sources import picture_fixture
from lumenary.sources.sidecar import ROUND_TRIP_SQL
from lumenary.sources.views import with_views
from lumenary.streaming import ingest, scans

_VISIBLE = "p.hidden = 0 and exists (select 1 from v_file f where f.blake3 = p.blake3 and f.state <> 'missing')"
_WINNER = "(select * from (select *, row_number() over (partition by photo_id order by (model = 'manual') desc, created_at desc, caption desc) as nth from v_annotation) q where nth = 1)"
_FIRST = "(select * from (select *, row_number() over (partition by blake3 order by id) as nth from v_file) q where nth = 1)"
_SIGNS = "list_reduce(list_transform(embedding, lambda x, i: case when x > 0 then (case when i = 64 then (-9223372036854775808)::bigint else (1::bigint << (i - 1)::bigint) end) else 0::bigint end), lambda a, b: a | b)"
_RAW = "('cr2','cr3','nef','arw','dng','orf','rw2','raf','pef','heic','heif')"
_PICTURES = "('jpg','jpeg','png','webp','heic','heif','gif','bmp','tif','tiff','avif','cr2','cr3','nef','arw','dng','orf','rw2','raf','pef')"
_VEC = "(select vec_id + 1 as id, embedding::double[] as v from embeddings)"
#: The mean vector of each group of rows (g, v), of length 1.
_MEAN = "(select g, list_transform(m, lambda x: x / greatest(sqrt(list_sum(list_transform(m, lambda y: y * y))), 1e-12)) as c from (select g, list(x order by i) as m from (select g, i, avg(x) as x from (select g, unnest(v) as x, unnest(range(1, 65)) as i from ({rows}) a) b group by g, i) c group by g) d)"
_PEOPLE = _MEAN.format(rows="select f.person_id as g, e.v from v_face f join " + _VEC + " e on e.id = f.id where f.confirmed = 1 and f.rejected = 0 and f.person_id is not null")
_COS = "round(list_dot_product(list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y)))), {c}), 6)"
_BOX = ", ".join(f"case when coalesce(src_w, 0) > 0 and coalesce(src_h, 0) > 0 then bbox_{c} / src_{s} else bbox_{c}::double end as {c}" for c, s in zip("xywh", "whwh"))
_OVER = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"
_IOU = f"({_OVER} / nullif(a.w * a.h + b.w * b.h - {_OVER}, 0))"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _faces(person="person_id", cluster="cluster_id", confirmed="confirmed", rejected="rejected", ignored="ignored_as", table="v_face"):
    """The state of all faces with some of its columns computed."""
    return f"select id, photo_id, {person} as person_id, {cluster} as cluster_id, {confirmed} as confirmed, {rejected} as rejected, {ignored} as ignored_as from {table}"


def _like(column, value):
    return f"lower({column}) like '%{value}%'"


_BM25 = f"""
select doc_id, round(score, 6) as score from (
  select tf.doc_id, sum(greatest(1e-6, ln((n.n - df.df + 0.5) / (df.df + 0.5))) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / n.mean))) as score, count(*) as words
  from (select doc_id, w, count(*) as tf from (select doc_id, unnest({_TOKENS}) as w from documents) t where w in ('by', 'whst') group by doc_id, w) tf
  join (select w, count(distinct doc_id) as df from (select doc_id, unnest({_TOKENS}) as w from documents) t group by w) df on df.w = tf.w
  join (select doc_id, len({_TOKENS}) as dl from documents) dl on dl.doc_id = tf.doc_id
  cross join (select count(*) as n, avg(len({_TOKENS})) as mean from documents) n group by tf.doc_id) s where words = 2
"""
_COLUMNS = {"caption": 8, "tags": 6, "ocr": 3, "people": 10, "filename": 2, "folder": 1, "place": 4}
#: Words that have the stem `by`; a word whose stem begins with `wh` begins so itself.
_BY = "regexp_full_match(x, 'by(s|ed|ing|ings)?')"


def _weighted(first: str, second: str, where: str = "true", phrase: bool = False) -> str:
    """Documents that hold two words (lambda x), scored by BM25 over weighted columns; `phrase`: three words, of which the first two stand in a row."""
    cut = ", ".join(f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+') as {c}" for c in _COLUMNS)
    count = lambda test: " + ".join(f"{w} * len(list_filter({c}, lambda x: {test}))" for c, w in _COLUMNS.items())
    one = " + ".join(f"{w} * len(list_filter({c}, lambda x, i: x = 'img' and {c}[i + 1] = '2'))" for c, w in _COLUMNS.items()) if phrase else count(first)
    return f"""
with doc as (select * from ({_BODY["fts_document"]}) d where {where}), cut as (select id, {cut} from doc),
f as (select id, {" + ".join(f"len({c})" for c in _COLUMNS)} as size, {one} as f0, {count(second)} as f1 from cut),
s as (select count(*) as n, avg(size) as mean, count(*) filter (f0 > 0) as d0, count(*) filter (f1 > 0) as d1 from f)
select id, round({" + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in (0, 1))}, 6) as score
from f, s where f0 > 0 and f1 > 0
"""


_TOP = """
select vec_id, score from (select vec_id, score, max(score) over () as top from (
  select b.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings b, (select embedding from embeddings where vec_id = 0) a order by score desc, vec_id limit 200) t) u
where score >= greatest(0.07, top * 0.2)
"""


def _fused(fts: str, vec: str) -> str:
    return f"""
select id, round(sum(1.0 / (60 + r)), 9) as score, string_agg(engine, ',' order by engine) as sources, row_number() over (order by round(sum(1.0 / (60 + r)), 9) desc, min(engine), min_by(r, engine)) as rank
from (select id, row_number() over (order by score desc, id) as r, 'fts' as engine from ({fts}) x union all select id, row_number() over (order by r), 'vec' from ({vec}) y) z group by id
"""


_ENGINES = f"WITH f0 as (select doc_id as id, score from ({_BM25}) b), v0 as (select vec_id as id, score, row_number() over (order by score desc, vec_id) as r from ({_TOP}) t), ok as (select p.id from v_photo p where {_VISIBLE}),"
_RRF = _ENGINES.rstrip(",") + _fused("select * from f0 order by score desc, id limit 200", "select * from v0")
_HYBRID = _ENGINES + "h as (" + _fused("select * from f0 where id in (select id from ok) order by score desc, id limit 8000", "select * from v0 where id in (select id from ok)") + ") "
_SHOWN = "select p.id, p.taken_at, f.rel_path, (p.id * 7919) % 100003 as rank from v_photo p join " + _FIRST + " f on f.blake3 = p.blake3 where p.hidden = 0"
_TIME = "case when coalesce(taken_at, 0) = 0 then '0000' else strftime(to_timestamp(taken_at) at time zone 'UTC', '{}') end"
_ARRIVALS = "select distinct on (root_id, rel_path) root_id, case when id % 3 = 0 then 'moved/' || rel_path else rel_path end as rel_path, 77 as size, case when id % 8 = 0 then md5((id - id % 16)::varchar) else blake3 end as blake3 from v_file where id % 4 = 0"
_NAMES = "select id, concat('IMG_20', lpad((id % 30)::varchar, 2, '0'), lpad((id % 14)::varchar, 2, '0'), lpad((id % 33)::varchar, 2, '0'), '_101010.jpg') as name from v_file"
_MOUNTS = "(values ('/', 'u-root', 'system'), ('/mnt/a', 's-1', 'A'), ('/mnt/a/b', 'mark-m-2', 'B'), ('/mnt/c', 'path-/mnt/c', 'C')) as m(mountpoint, volume, label)"
_CLOSE = f"(select h.vec_id, xor(b.h, xor(xor(1::bigint << (h.vec_id % 61), 1::bigint << (h.vec_id % 47)), (h.vec_id % 16) << 13)) as h from embeddings h join (select vec_id, {_SIGNS} as h from embeddings where vec_id < 10) b on b.vec_id = h.vec_id % 10)"
_RECLUSTER = f"""
WITH RECURSIVE u as materialized (select f.id, e.v from v_face f join {_VEC} e on e.id = f.id where f.person_id is null and f.rejected = 0),
s as materialized (select u.id, c.g as person, {_COS.format(v="u.v", c="c.c")} as sim from u, {_PEOPLE} c),
known as materialized (select id, person from (select *, row_number() over (partition by id order by sim desc, person) as nth from s) q where nth = 1 and sim >= 0.2),
r0 as materialized (select * from u where id not in (select id from known)),
e as materialized (select a.id as x, b.id as y from r0 a join r0 b on a.id <> b.id and round(list_dot_product(a.v, b.v), 6) >= 0.35),
core as materialized (select x from e group by x having count(*) + 1 >= 3),
r as (select x, x as y from core union select r.x, e.y from r join e on e.x = r.y join core c on c.x = e.y),
lab as materialized (select x as id, min(y) as label from r group by x),
every as (select * from lab union all select e.x, min(l.label) from e join lab l on l.id = e.y where e.x not in (select x from core) group by e.x),
num as (select id, dense_rank() over (order by label) as place from every),
base as (select coalesce(max(case when f.person_id is not null then f.cluster_id end), 0) as top from v_face f)
select f.id, coalesce(f.person_id, k.person) as person_id, coalesce(b.top + n.place, case when f.person_id is not null then f.cluster_id end) as cluster_id, case when k.id is not null then 0 else f.confirmed end as confirmed
from v_face f left join known k on k.id = f.id left join num n on n.id = f.id, base b
"""

_DBSCAN = """
WITH RECURSIVE e as (select a.vec_id as x, b.vec_id as y from embeddings a join embeddings b on a.vec_id <> b.vec_id and round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) >= 0.35),
core as (select x from e group by x having count(*) + 1 >= 3),
r as (select x, x as y from core union select r.x, e.y from r join e on e.x = r.y join core c on c.x = e.y),
lab as (select x as id, min(y) as label from r group by x),
border as (select e.x as id, min(l.label) as label from e join lab l on l.id = e.y where e.x not in (select x from core) group by e.x)
select id, label from lab union all select id, label from border
"""
#: Rows in order; each step appends a row to the seeds, or doesn't.
_NEAR_GROUPS = f"""
WITH RECURSIVE h as (select vec_id, {_SIGNS} as h from embeddings),
p as (select a.vec_id as a, b.vec_id as b from h a join h b on a.vec_id < b.vec_id and bit_count(xor(a.h, b.h)) <= 18),
n as (select id, row_number() over (order by id) as r, list(a) filter (where a is not null) as before from (select b as id, a from p union all select a, null from p) t group by id),
s as (select 0::bigint as r, []::bigint[] as seeds union all select n.r, case when list_has_any(s.seeds, coalesce(n.before, []::bigint[])) then s.seeds else list_append(s.seeds, n.id) end from s join n on n.r = s.r + 1),
k as (select unnest(seeds) as seed from s where r = (select max(r) from s))
select seed, seed as member from k union all select seed, b from k join p on p.a = seed union all select seed, a from k join p on p.b = seed
"""

_BODY = {
    "browse_newest": "select id, taken_at from v_photo where hidden = 0 order by taken_at desc nulls last, id limit 50",
    "browse_oldest": "select id, taken_at from v_photo where hidden = 0 order by taken_at asc nulls first, id limit 50 offset 20",
    "browse_added": "select id, created_at from v_photo where hidden = 0 order by created_at desc, id limit 50 offset 10",
    "browse_name": f"select p.id, f.filename from v_photo p join {_FIRST} f on f.blake3 = p.blake3 where p.hidden = 0 order by f.filename, p.id limit 50",
    "filter_person": f"select p.id from v_photo p where exists (select 1 from v_face f join v_person n on n.id = f.person_id where f.photo_id = p.id and {_like('n.name', 'asia')}) and {_VISIBLE}",
    "filter_tag": f"select p.id from v_photo p where exists (select 1 from v_photo_tag t where t.photo_id = p.id and t.name = 'fr') and exists (select 1 from v_photo_tag t where t.photo_id = p.id and t.name = 'src3') and {_VISIBLE}",
    "filter_camera": f"select p.id, p.camera_model from v_photo p where ({_like('p.camera_model', 'econ')} or {_like('p.camera_make', 'econ')}) and {_VISIBLE}",
    "filter_folder_filename": f"select p.id from v_photo p where exists (select 1 from v_file f where f.blake3 = p.blake3 and {_like('f.rel_path', 'en/src1')}) and exists (select 1 from v_file f where f.blake3 = p.blake3 and {_like('f.filename', '.jpg')}) and {_VISIBLE}",
    "filter_place": f"select p.id, p.place_name from v_photo p where {_like('p.place_name', 'nation_1')} and {_VISIBLE}",
    "filter_favorite": f"select p.id from v_photo p where p.favorite = 1 and {_VISIBLE}",
    "filter_dates_inclusive": f"select p.id, p.taken_at from v_photo p where p.taken_at between 1704499200 and 1708387200 and {_VISIBLE}",
    "filter_has_faces": f"select p.id from v_photo p where p.id in (select photo_id from v_face) and {_VISIBLE}",
    "filter_no_faces": f"select p.id from v_photo p where p.id not in (select photo_id from v_face) and {_VISIBLE}",
    "visible_photos": f"select p.id from v_photo p where {_VISIBLE}",
    "like_wildcards": "select id, filename from v_file where regexp_matches(lower(filename), 'img.1.4[.]')",
    "map_points": "select p.id, p.gps_lat, p.gps_lon, (select arg_max(caption, created_at) from v_annotation a where a.photo_id = p.id) as caption from v_photo p where p.gps_lat is not null and p.hidden = 0 order by p.taken_at desc nulls last, p.id limit 5000",
    "page_columns": f"select p.id, p.bytes, f.rel_path from (select * from v_photo order by id limit 40) p join {_FIRST} f on f.blake3 = p.blake3",
    "photo_detail": f"""select p.id, p.camera_model, w.caption, t.tags, fc.faces, fl.files from v_photo p left join {_WINNER} w on w.photo_id = p.id
      left join (select photo_id, string_agg(source || ':' || name, ',' order by source desc, name) as tags from v_photo_tag group by photo_id) t on t.photo_id = p.id
      left join (select f.photo_id, string_agg(f.id::varchar || ':' || coalesce(n.name, '?'), ',' order by f.id) as faces from v_face f left join v_person n on n.id = f.person_id where f.rejected = 0 group by f.photo_id) fc on fc.photo_id = p.id
      left join (select f.blake3, string_agg(v.label || ':' || f.rel_path, ',' order by f.id) as files from v_file f join v_root r on r.id = f.root_id join v_volume v on v.id = r.volume_id group by f.blake3) fl on fl.blake3 = p.blake3""",
    "root_volume": "select r.id, v.label, r.rel_path, v.online from v_root r, v_volume v where v.id = r.volume_id",
    "readable_path": "select id, rel_path from (select p.id, f.rel_path, row_number() over (partition by p.id order by f.state = 'present' desc, f.id) as nth from v_photo p join v_file f on f.blake3 = p.blake3 join v_root r on r.id = f.root_id join v_volume v on v.id = r.volume_id and v.online = 1 where f.id % 19 <> 0) q where nth = 1",
    "winner_annotation": f"select photo_id, caption, scene from {_WINNER} w",
    "fts_document": f"""select p.id, concat_ws(' ', w.caption, w.scene) as caption, t.tags, w.ocr_text as ocr, n.people, f.filename, f.folder, p.place_name as place from v_photo p left join {_WINNER} w on w.photo_id = p.id
      left join (select photo_id, string_agg(name, ' ' order by name) as tags from v_photo_tag group by photo_id) t on t.photo_id = p.id
      left join (select f.photo_id, string_agg(distinct n.name, ' ' order by n.name) as people from v_face f join v_person n on n.id = f.person_id group by f.photo_id) n on n.photo_id = p.id
      left join (select blake3, string_agg(filename, ' ' order by id) as filename, string_agg(coalesce(nullif(regexp_extract(rel_path, '^(.*)/[^/]*$', 1), ''), '.'), ' ' order by id) as folder from (select *, row_number() over (partition by blake3 order by id) as nth from v_file) q where nth <= 4 group by blake3) f on f.blake3 = p.blake3""",
    "exact_duplicates": "select p.id, p.bytes, count(*) as n, string_agg(v.label || ': ' || f.rel_path, chr(10) order by v.label || ': ' || f.rel_path) as paths from v_photo p join v_file f on f.blake3 = p.blake3 join v_root r on r.id = f.root_id join v_volume v on v.id = r.volume_id group by p.id, p.bytes having count(*) > 1 order by p.bytes * (count(*) - 1) desc, p.id limit 200",
    "wasted_bytes": "select sum(extra)::bigint as wasted from (select p.bytes * (count(*) - 1) as extra from v_photo p join v_file f on f.blake3 = p.blake3 group by p.id, p.bytes having count(*) > 1 order by extra desc, p.id limit 200) t",
    "tag_counts": "select name, count(photo_id) as n from v_photo_tag group by name",
    "people_counts": "select n.id, n.name, (select count(*) from v_face f where f.person_id = n.id and f.rejected = 0) as n, (select f.id from v_face f where f.person_id = n.id order by f.det_score desc, f.id limit 1) as cover from v_person n",
    "people_counts_cli": "select n.id, n.name, count(f.id) as n from v_person n left join v_face f on f.person_id = n.id group by all",
    "naming_queue": "select c.cluster_id, c.n, f.id as face_id, f.r from (select cluster_id, count(*) as n from v_face where cluster_id is not null and person_id is null and rejected = 0 group by cluster_id order by n desc, cluster_id limit 60) c join (select *, row_number() over (partition by cluster_id order by det_score desc, id) as r from v_face) f on f.cluster_id = c.cluster_id and f.r <= 12",
    "cluster_faces": f"select f.id, f.photo_id, f.det_score, p.taken_at, w.caption, i.filename from v_face f join v_photo p on p.id = f.photo_id left join {_WINNER} w on w.photo_id = p.id left join {_FIRST} i on i.blake3 = p.blake3 where f.id in (select id from v_face where cluster_id = 5 order by det_score desc, id limit 30)",
    "ignored_groups": "select g.ignored_as as cluster_id, g.n, f.id as face_id, f.r, (select count(*) from v_face where rejected = 1 and ignored_as is null) as loose from (select ignored_as, count(*) as n from v_face where rejected = 1 and ignored_as is not null group by ignored_as order by n desc, ignored_as limit 3) g join (select *, row_number() over (partition by ignored_as order by det_score desc, id) as r from v_face where rejected = 1) f on f.ignored_as = g.ignored_as and f.r <= 6",
    "root_stats": "select r.id, count(distinct f.blake3) as photos, count(*) filter (f.state = 'missing') as missing from v_root r left join v_file f on f.root_id = r.id group by r.id",
    "lib_stats": "select (select count(*) from v_photo) as photos, (select count(*) from v_file) as files, (select count(*) from v_face) as faces, (select count(*) from v_person) as people, (select count(distinct name) from v_photo_tag) as tags, (select count(distinct photo_id) from v_annotation) as captioned, (select count(*) from embeddings) as embedded",
    "timeline_groups": f"select key, n, row_number() over (order by key desc) as place from (select {_TIME.format('%Y%m%d')} as key, count(*) as n from ({_SHOWN}) s group by key) t",
    "timeline_searched": f"select key, n, row_number() over (order by first) as place from (select {_TIME.format('%Y%m')} as key, count(*) as n, min(rank) as first from ({_SHOWN}) s group by key) t",
    "timeline_folders": f"select key, n, row_number() over (order by first) as place from (select array_to_string(string_split(rel_path, '/')[:-2], '/') as key, count(*) as n, min(rank) as first from ({_SHOWN}) s group by key) t",
    "match_sources": f"{_ENGINES} x as ({_RRF[len(_ENGINES) - 1:]}) select s as source, count(*) as n from (select unnest(string_split(sources, ',')) as s from x) y group by s",
    "captioner_bench": "select round(median(value), 6) as median, round(avg(value), 6) as mean, round(sum(user_id % 400) / sum(value), 6) as tokens_per_second, round(median(user_id % 400), 6) as median_tokens, round(median(value) * 500000 / 86400, 6) as days from events",
    "human_bytes": "select id, case when coalesce(n, 0) = 0 then '-' when n < 1024 then printf('%d B', n) when n < 1048576 then printf('%.1f KB', n / 1024.0) when n < 1073741824 then printf('%.1f MB', n / 1048576.0) else printf('%.1f GB', n / 1073741824.0) end as size from (select id, size * (40 ** (id % 6))::bigint * (id % 8) as n from v_file) t",
    "parent_folders": "select id, case when id % 5 = 0 then '.' else array_to_string(string_split(rel_path, '/')[:-2], '/') end as folder from v_file",
    "thumb_paths": "select id, blake3[1:2] || '/' || blake3[3:4] || '/' || blake3 || '_grid.webp' as path from v_photo",
    "filename_dates": f"select id, name, try_strptime(regexp_extract(name, '(20[0-9]{{6}})', 1), '%Y%m%d')::date::varchar as day from ({_NAMES}) t",
    "gps_degrees": "select id, round((case when id % 2 = 0 then -1 else 1 end) * (1 + id % 90 + (id % 60)::double / 60 + (id % 37)::double / 3600), 7) as degrees from v_file",
    "walk_pictures": f"select id, (case id % 7 when 2 then '' else '' end) || rel_path as rel_path from v_file where id % 7 not in (0, 1, 2) and id % 11 <> 0 and lower(regexp_extract(rel_path, '[.]([^.]*)$', 1)) in {_PICTURES}",
    "scan_cdc": "select coalesce(n.rel_path, o.rel_path) as rel_path, case when o.rel_path is null then 'new' when n.rel_path is null then 'missing' when n.mtime = o.mtime and n.size = o.size then 'unchanged' else 'changed' end as status from (select * from v_file where root_id = 4) o full join (select rel_path, mtime + (id % 5 = 0)::int as mtime, size from v_file where root_id = 4 and id % 7 <> 0 union all select 'new/' || rel_path, mtime, size from v_file where root_id = 5) n on n.rel_path = o.rel_path",
    "scan_forced": "select rel_path, 'changed' as status from v_file where root_id = 4",
    "mark_missing": "select id, if(root_id = 4 and state = 'present' and id % 10 < 4, 'missing', state) as state from v_file",
    "root_offline": "select id, if(root_id = 3 and state <> 'missing', 'offline', state) as state from v_file",
    "root_online": "select id, if(root_id = 3 and state <> 'missing', 'present', state) as state from v_file",
    "ingest_files": f"select coalesce(n.root_id, o.root_id) as root_id, coalesce(n.rel_path, o.rel_path) as rel_path, coalesce(n.blake3, o.blake3) as blake3, case when n.root_id is not null then 'present' else o.state end as state from v_file o full join ({_ARRIVALS}) n on n.root_id = o.root_id and n.rel_path = o.rel_path",
    "ingest_photos": f"select blake3, bytes from v_photo union all select blake3, min(size) from ({_ARRIVALS}) n where blake3 not in (select blake3 from v_photo) group by blake3",
    "mounted_on": f"select id, volume, label, ltrim(substr(path, length(rtrim(mountpoint, '/')) + 1), '/') as rel_path from (select f.*, m.*, row_number() over (partition by f.id order by length(m.mountpoint) desc) as nth from (select id, case id % 4 when 0 then '/mnt/a/' when 1 then '/mnt/a/b/' when 2 then '/mnt/ab/' else '/mnt/c/' end || rel_path as path from v_file) f join {_MOUNTS} on f.path = m.mountpoint or starts_with(f.path, rtrim(m.mountpoint, '/') || '/')) q where nth = 1",
    "current_mountpoints": f"select u.uuid, m.mountpoint from (values ('s-1'), ('mark-m-2'), ('path-/mnt/c'), ('u-gone')) as u(uuid) left join {_MOUNTS} on m.volume = u.uuid",
    "library_state": "select path, case when path in ('/p/en', '/p/fr/src1') then 'root' when starts_with(path, '/p/en/') or starts_with(path, '/p/fr/src1/') then 'inside' when path in ('/p', '/p/fr') then 'contains' end as library from (select distinct '/p/' || lang as path from documents union all select distinct '/p/' || lang || '/' || source from documents union all select '/p' union all select '/q') t",
    "browse_folder": "select source as name, '/p/en/' || source as path, count(*) as images, if(source = 'src1', 'root', null) as library from documents where lang = 'en' group by source",
    "prune_orphans": "select p.id from v_photo p where p.blake3 not in (select blake3 from v_file where state <> 'missing')",
    "prune_tags": "select t.* from v_photo_tag t join v_photo p on p.id = t.photo_id where p.blake3 in (select blake3 from v_file where state <> 'missing')",
    "remove_root": "select p.id from v_photo p where p.blake3 not in (select blake3 from v_file where state <> 'missing' and root_id <> 4)",
    "removal_counts": "select (select count(*) from v_file where root_id = 4) as files, (select count(*) from v_photo p where p.blake3 not in (select blake3 from v_file where state <> 'missing' and root_id <> 4)) as photos",
    "job_stats": "select stage, state, count(*) as n from v_job group by stage, state",
    "job_grid": "select stage, count(*) filter (state = 'pending') as pending, count(*) filter (state = 'running') as running, count(*) filter (state = 'done') as done, count(*) filter (state = 'failed') as failed from v_job group by stage",
    "job_claim": "select id, stage, 'running' as state, attempts + 1 as attempts from v_job where stage = 'embed' and state = 'pending' order by priority, id limit 16",
    "job_finish": "select id, if(state <> 'running', state, if(id % 2 = 0, 'done', 'failed')) as state, if(state = 'running' and id % 2 = 1, 500, null) as letters from v_job",
    "job_requeue": "select id, if(state = 'running' and attempts < 5, 'pending', state) as state from v_job",
    "job_unclaim": "select id, if(state = 'running', 'pending', state) as state, if(state = 'running', greatest(attempts - 1, 0), attempts) as attempts from v_job",
    "job_retry_failed": "select id, if(state = 'failed' and stage = 'faces', 'pending', state) as state, if(state = 'failed' and stage = 'faces', 0, attempts) as attempts from v_job",
    "job_enqueue_all": "select photo_id, stage, state, attempts from v_job union all select p.id, s.stage, 'pending', 0 from v_photo p, (values ('thumbs'), ('embed'), ('faces'), ('caption')) as s(stage) where not exists (select 1 from v_job j where j.photo_id = p.id and j.stage = s.stage)",
    "job_reset_stage": "select photo_id, stage, if(stage = 'faces' and photo_id in (select id from v_photo), 'pending', state) as state, if(stage = 'faces' and photo_id in (select id from v_photo), 0, attempts) as attempts from v_job union all select p.id, 'faces', 'pending', 0 from v_photo p where p.id not in (select photo_id from v_job where stage = 'faces')",
    "reset_discards": "select id from v_face where confirmed = 1 or rejected = 1",
    "stage_run": "select p.id, case when not p.here then 'pending' when len(string_split_regex(trim(d.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+')) < 5 then 'failed' else 'done' end as state, 1 as attempts from (select id, blake3 in (select blake3 from v_file where state = 'present') as here from v_photo) p join documents d on d.doc_id = p.id",
    "set_tags_replace": "select photo_id, name, source from v_photo_tag where source <> 'ai' or photo_id % 10 <> 0 union all select id, 'replaced', 'ai' from v_photo where id % 10 = 0",
    "upsert_files": "select root_id, rel_path, if(id % 3 = 0 and id % 2 = 1, size + 1, size) as size, if(id % 3 = 0 and id % 2 = 1, 'present', state) as state from v_file union all select root_id, 'x/' || rel_path, size + 1, 'present' from v_file where id % 6 = 0",
    "upsert_roots": "select volume_id, rel_path, if(volume_id % 2 = 0 and length(label) % 2 = 1, 'again', label) as label, if(volume_id % 2 = 0 and length(label) % 2 = 1, 1, 0) as enabled, rel_path || '*' as globs from v_root union all select volume_id, rel_path || '/sub', 'again', 1, '' from v_root where volume_id % 2 = 0 and length(label) % 2 = 0",
    "favorite_toggle": "select id, if(id % 3 = 0, 1, favorite) as favorite from v_photo",
    "manual_edit": f"select p.id as photo_id, if(p.id % 8 = 0, 'by hand', w.caption) as caption, w.scene, '' as ocr_text, 1800000000 as created_at from v_photo p join {_WINNER} w on w.photo_id = p.id where p.id % 4 = 0 union all select photo_id, caption, scene, ocr_text, created_at from v_annotation where model = 'manual' and photo_id % 4 <> 0",
    "manual_revert": "select photo_id, arg_max(caption, created_at) as caption from v_annotation where model <> 'manual' group by photo_id",
    "keyword_import": "select photo_id, string_agg(name, ',' order by name) as tags from (select photo_id, name from v_photo_tag where source = 'manual' union select id, k from v_photo, (values ('holiday'), ('kerala'), ('beach'), ('fr')) as t(k) where id % 5 = 0) t group by photo_id",
    "sidecar_paths": f"select p.id, 'app/' || v.label || ' _1_' || v.id || '/' || f.rel_path || '.xmp' as path from v_photo p join {_FIRST} f on f.blake3 = p.blake3 join v_root r on r.id = f.root_id join v_volume v on v.id = r.volume_id",
    "sidecar_paths_beside": f"select p.id, f.rel_path || '.xmp' as path from v_photo p join {_FIRST} f on f.blake3 = p.blake3",
    "sidecar_export_ids": "select p.id from v_photo p where p.blake3 in (select blake3 from v_file where state = 'present') order by p.id limit 300",
    "sidecar_export_counts": "select count(*) as total, count(*) filter (not r) as offline, count(*) filter (r and id % 6 = 0) as skipped, count(*) filter (r and id % 6 <> 0 and id % 5 <> 0) as written from (select p.id, p.blake3 in (select f.blake3 from v_file f join v_root t on t.id = f.root_id join v_volume v on v.id = t.volume_id where v.online = 1) as r from v_photo p where p.blake3 in (select blake3 from v_file where state = 'present' and root_id = 7)) q",
    "sidecar_collect": f"""select p.id, w.caption, t.tags, n.people, if(p.favorite = 1, 5, null) as rating from v_photo p left join {_WINNER} w on w.photo_id = p.id
      left join (select photo_id, string_agg(name, ',' order by o, name) as tags from (select distinct photo_id, name, source <> 'manual' as o from v_photo_tag) d group by photo_id) t on t.photo_id = p.id
      left join (select f.photo_id, string_agg(n.name, ',' order by n.name) as people from v_face f join v_person n on n.id = f.person_id where f.rejected = 0 and f.src_w is not null group by f.photo_id) n on n.photo_id = p.id""",
    "region_normalise": "select id, round((bbox_x + bbox_w * 0.5) / src_w, 9) as x, round((bbox_y + bbox_h * 0.5) / src_h, 9) as y, round(bbox_w / src_w, 9) as w, round(bbox_h / src_h, 9) as h from v_face where src_w is not null and rejected = 0",
    "hamming_pairs": f"select a.vec_id as a, b.vec_id as b, bit_count(xor(a.h, b.h)) as distance from (select vec_id, {_SIGNS} as h from embeddings) a join (select vec_id, {_SIGNS} as h from embeddings) b on a.vec_id < b.vec_id and bit_count(xor(a.h, b.h)) <= 18",
    "hamming_pairs_near": f"select a.vec_id as a, b.vec_id as b, bit_count(xor(a.h, b.h)) as distance from {_CLOSE} a join {_CLOSE} b on a.vec_id < b.vec_id and bit_count(xor(a.h, b.h)) <= 6",
    "format_pairs": f"select shot, count(*) as n from (select id - id % 2 as shot, if(id % 9 = 0, '', lower(regexp_extract(filename, '^(.*)[.]', 1))) as stem, if(id % 9 = 0, 'nef', lower(regexp_extract(filename, '[.]([^.]*)$', 1))) as ext from v_file) f group by shot having count(*) > 1 and bool_and(stem <> '') and count(distinct stem) = 1 and count(distinct ext) = count(*) and bool_or(ext in {_RAW})",
    "iou_pairs": f"select a.id as a, b.id as b, round({_IOU}, 6) as iou from (select id, photo_id, bbox_x::double as x, bbox_y::double as y, bbox_w::double as w, bbox_h::double as h from v_face) a join (select id, photo_id, bbox_x::double as x, bbox_y::double as y, bbox_w::double as w, bbox_h::double as h from v_face) b on a.photo_id = b.photo_id and a.id < b.id where {_IOU} >= 0.5",
    "face_crops": "select id, trunc(l)::int as x1, trunc(t)::int as y1, trunc(greatest(least(r, 300), l + 1))::int as x2, trunc(greatest(least(b, 900), t + 1))::int as y2 from (select id, least(greatest(x - w * 0.35, 0.0), 299) as l, least(greatest(y - h * 0.35, 0.0), 899) as t, x + w * 1.35 as r, y + h * 1.35 as b from (select id, bbox_x * sx as x, bbox_y * sy as y, bbox_w * sx as w, bbox_h * sy as h from (select *, if(src_w is null, 1.0::double, 300.0::double / src_w) as sx, if(src_h is null, 1.0::double, 900.0::double / src_h) as sy from v_face) a) c) d",
    "decided_boxes": "select id, " + ", ".join(f"round({c}, 6) as {c}" for c in "xywh") + f" from (select id, {_BOX} from v_face where confirmed = 1 or rejected = 1) q",
    "decided_face_merge": f"""WITH found as (select id, photo_id, bbox_x + if(id % 2 = 0, 400, 3) as bbox_x, bbox_y, bbox_w, bbox_h, src_w, src_h from v_face where id % 3 = 0)
      select photo_id, bbox_x, bbox_y, bbox_w, confirmed, rejected from v_face where confirmed = 1 or rejected = 1 or photo_id not in (select photo_id from found)
      union all select f.photo_id, f.bbox_x, f.bbox_y, f.bbox_w, 0, 0 from found f where not exists (select 1 from (select photo_id, {_BOX} from v_face where confirmed = 1 or rejected = 1) b, (select id, {_BOX} from found) a where a.id = f.id and b.photo_id = f.photo_id and {_IOU} >= 0.5)""",
    "person_centroids": f"select g as person_id, (unnest(range(0, 64)))::int as pos, round(unnest(c), 6) as x from {_PEOPLE} m",
    "assign_known": f"select id as face_id, person as person_id, sim from (select *, row_number() over (partition by id order by sim desc, person) as nth from (select f.id, p.g as person, {_COS.format(v='e.v', c='p.c')} as sim from v_face f join {_VEC} e on e.id = f.id, {_PEOPLE} p where f.person_id is null and f.rejected = 0) s) q where nth = 1 and sim >= 0.2",
    "suggest_people": f"select g as cluster_id, person as person_id, n.name, round(sim, 3) as score, nth as r from (select *, row_number() over (partition by g order by sim desc, person) as nth from (select c.g, p.g as person, round(list_dot_product(c.c, p.c), 6) as sim from {_MEAN.format(rows='select f.cluster_id as g, e.v from v_face f join ' + _VEC + ' e on e.id = f.id where f.rejected = 0 and f.cluster_id is not null')} c, {_PEOPLE} p) s) q join v_person n on n.id = q.person where nth <= 2 and sim >= 0",
    "max_cluster": "select max(cluster_id) + 1 as next_id from v_face",
    "recluster": _RECLUSTER,
    "recluster_too_few": "select f.id, case when f.person_id is not null then f.cluster_id end as cluster_id from v_face f",
    "person_for_name": "select id, name from v_person union all select 5, 'New One'",
    "name_cluster": _faces("if(cluster_id = 5, 5, person_id)", "if(cluster_id = 5, null, cluster_id)", "if(cluster_id = 5, 1, confirmed)"),
    "name_cluster_cover": "select id, name, null::bigint as cover_face_id from v_person union all select 5, 'Someone New', (select id from v_face where cluster_id = 5 order by det_score desc, id limit 1)",
    "name_face": _faces("if(id = 30, (select id from v_person where lower(name) = 'asia'), person_id)", "if(id = 30, null, cluster_id)", "if(id = 30, 1, confirmed)", "if(id = 30, 0, rejected)", "if(id = 30, null, ignored_as)"),
    "merge_clusters": _faces(cluster="if(cluster_id in (6, 7, 8), 6, cluster_id)"),
    "merge_and_name": _faces("if(cluster_id in (6, 7), (select id from v_person where lower(name) = 'europe'), person_id)", "if(cluster_id in (6, 7), null, cluster_id)", "if(cluster_id in (6, 7), 1, confirmed)"),
    "ignore_cluster": _faces(cluster="nullif(cluster_id, 8)", rejected="if(cluster_id = 8, 1, rejected)", ignored="if(cluster_id = 8, 8, ignored_as)"),
    "ignore_face": _faces("if(id = 5, null, person_id)", "if(id = 5, null, cluster_id)", "if(id = 5, 0, confirmed)", "if(id = 5, 1, rejected)"),
    "restore_ignored": _faces(cluster="if(rejected = 1 and ignored_as = 4, 4, cluster_id)", rejected="if(ignored_as = 4, 0, rejected)", ignored="nullif(ignored_as, 4)"),
    "detach_face": _faces("if(id = 1, null, person_id)", "if(id = 1, null, cluster_id)", "if(id = 1, 0, confirmed)"),
    "assign_face": _faces("if(id = 5, 2, person_id)", "if(id = 5, null, cluster_id)", "if(id = 5, 1, confirmed)"),
    "merge_people": _faces("if(person_id = 3, 1, person_id)"),
    "rename_person": "select id, if(id = 2, 'Ann', name) as name from v_person",
    "delete_person": _faces("nullif(person_id, 4)", confirmed="if(person_id = 4, 0, confirmed)"),
    "vector_topk_cutoff": _TOP,
    "vector_index": "select vec_id as photo_id, round(list_sum(embedding::double[]), 4) as total from embeddings where vec_id % 4 <> 0",
    "fts_prefix_and": f"select doc_id from (select doc_id, {_TOKENS} as ws from documents) t where list_contains(ws, 'by') and len(list_filter(ws, lambda w: starts_with(w, 'wh'))) > 0",
    "fts_bm25": _BM25,
    "hybrid_search": _HYBRID + "select * from h where rank <= 400",
    "rrf_fusion": _RRF,
    "search_filter_only": f"select id, round(1.0 / (60 + r), 9) as score, 'filter' as sources, r as rank from (select p.id, row_number() over (order by p.taken_at desc nulls last, p.id) as r from v_photo p where p.id in (select photo_id from v_photo_tag where name = 'fr') and {_VISIBLE}) q where r <= 25",
    "search_fallback": f"select id, round(1.0 / (60 + r), 9) as score, 'filter' as sources, r as rank from (select p.id, row_number() over (order by p.taken_at desc nulls last, p.id) as r from v_photo p where {_like('p.place_name', 'nation_1')} and {_VISIBLE}) q where r <= 25",
    "search_no_match": "select 0 as n",
    "search_paging": _HYBRID + f"select h.id, h.rank, round(h.score, 5) as score, h.sources, f.filename, (select least(count(*), 400) from h) as total, false as capped from h join v_photo p on p.id = h.id join {_FIRST} f on f.blake3 = p.blake3 where h.rank between 6 and 15",
    "typed_search": f"""select p.id from v_photo p where {_VISIBLE} and exists (select 1 from v_photo_tag t where t.photo_id = p.id and t.name = 'fr') and {_like('p.place_name', 'nation_1')}
      and ({_like('p.camera_model', 'a')} or {_like('p.camera_make', 'a')}) and p.taken_at between 1720612800 - 365 * 86400 and 1720612800""",
    "dbscan_labels": _DBSCAN,
    "near_duplicate_groups": _NEAR_GROUPS,
    "annotation_salvage": lenient_json.SALVAGE_SQL,
    "filename_dates_all": imaging.NAME_DATES_SQL,
    "sidecar_round_trip": ROUND_TRIP_SQL,
    "stream_ingest_jobs": ingest.JOBS_SQL,
}
_BODY["vector_topk_codes"] = _TOP
_BODY["fts_weighted_stemmed"] = _weighted(_BY, "starts_with(x, 'wh')")
_BODY["fts_incremental"] = _weighted(_BY, "starts_with(x, 'wh')", "id % 7 <> 0")
_BODY["fts_phrase"] = _weighted("", "starts_with(x, 'en')", phrase=True)
_BODY["fts_top"] = f"select * from ({_BODY['fts_weighted_stemmed']}) q order by score desc, id limit 50"
_BODY["duplicate_faces"] = f"""
with recursive o as (
  select *, row_number() over (partition by photo_id order by not decided, id) as n from (
    select id, photo_id, person_id, coalesce(rejected, 0) as rejected, coalesce(confirmed, 0) = 1 or coalesce(rejected, 0) = 1 as decided, {_BOX} from v_face) q),
p as (
  select b.photo_id, b.n, list({{'e': a.n, 'agrees': not (b.decided and (a.rejected <> b.rejected or coalesce(a.person_id <> b.person_id, false)))}} order by a.n) as near
  from o a join o b on a.photo_id = b.photo_id and a.n < b.n where {_IOU} >= 0.5 group by b.photo_id, b.n),
r as (
  select photo_id, n, [n] as kept from o where n = 1
  union all
  select photo_id, n, if(f is null or not f.agrees, list_append(kept, n), kept) from (
    select o.photo_id, o.n, r.kept, list_filter(p.near, lambda s: list_contains(r.kept, s.e))[1] as f
    from r join o on o.photo_id = r.photo_id and o.n = r.n + 1 left join p on p.photo_id = o.photo_id and p.n = o.n) q)
select o.id from o join (select photo_id, arg_max(kept, n) as kept from r group by photo_id) k on k.photo_id = o.photo_id where not list_contains(k.kept, o.n)
"""
_DEEP = "(select '/mnt/' || rel_path as folder, 's-' || id as volume, label from v_root union all select '/mnt/' || rel_path || '/en', 'd-' || id, label || ' en' from v_root where id % 3 = 0)"
_BODY["mounted_deep"] = f"select id, volume, label, substr(path, length(folder) + 2) as rel_path from (select f.id, f.path, m.*, row_number() over (partition by f.id order by length(m.folder) desc) as nth from (select f.id, '/mnt/' || r.rel_path || '/' || f.rel_path as path from v_file f join v_root r on r.id = f.root_id) f join {_DEEP} m on starts_with(f.path, m.folder || '/')) q where nth = 1"
_BODY["mountpoints_now"] = "select case when id % 5 = 0 then 'gone-' else 's-' end || id as uuid, case when id % 5 <> 0 then '/mnt/' || rel_path end as mountpoint from v_root"
_BODY["library_state_deep"] = """with r as (select distinct '/p/' || if(id % 80 = 7, string_split(rel_path, '/')[1], rel_path) as path from v_file where id % 40 = 7),
p as (select distinct '/p/' || regexp_extract(rel_path, '^(.*)/', 1) as path from v_file),
s as (select path, case when path in (select path from r) then 'root' when exists (select 1 from r where starts_with(p.path, r.path || '/')) then 'inside' when exists (select 1 from r where starts_with(r.path, p.path || '/')) then 'contains' end as library from p)
select f.id, s.path, s.library from v_file f join s on s.path = '/p/' || regexp_extract(f.rel_path, '^(.*)/', 1)"""
_BODY["like_accents"] = "select id, 'École_' || filename as filename from v_file where id % 3 = 0"
_BODY["photo_detail_some"] = f"select * from ({_BODY['photo_detail']}) q where id % 50 = 3"
_BODY["upsert_repeated"] = "select volume_id, rel_path, if(id % 2 = 0, greatest(label, 'b'), label) as label from v_root"
_BODY["stream_scans"] = scans.THREE_SCANS_SQL
_BODY["picture_meta"] = picture_fixture.READ_BACK_SQL
_BODY["caption_stage"] = r"select doc_id, case when n < 5 then 'failed' else 'done' end as state, case when n >= 5 then array_to_string(w[1:5], ' ') end as caption, case when n >= 5 then array_to_string(list_sort(list_distinct([lower(w[1]), lower(w[2])])), ',') end as tags, case when n < 5 then 'too few words' end as error from (select doc_id, w, len(w) as n from (select doc_id, list_filter(string_split_regex(text, '[\s\x1c-\x1f\x85\xa0]+'), lambda x: x <> '') as w from documents) a) b"
_BODY["face_stage"] = providers.FACE_SQL
_BODY["image_stage"] = providers.IMAGE_SQL
_BODY["searches_understood"] = request.UNDERSTOOD_SQL
_BODY["searches_of_all_kinds"] = request.ALL_KINDS_SQL
_BODY["annotation_damage"] = lenient_json.DAMAGE_SQL
_BODY["phash_pictures"] = imaging.PHASH_SQL
_BODY["upsert_partitioned"] = "select rel_path, if(root_id % 6 = 1 and size % 2 = 0, size + 1, size) as size, if(root_id % 6 = 1 and size % 2 = 0, 'present', state) as state, root_id from v_file union all select 'x/' || rel_path, size, 'present', root_id from v_file where root_id % 6 = 1 and size % 2 = 0"
_ALLOWED = f"(select p.id from v_photo p where {_like('p.place_name', 'nation_1')} and {_VISIBLE})"
_INDEXED = _fused(
    f"select * from ({_BODY['fts_weighted_stemmed']}) q where id in {_ALLOWED} order by score desc, id limit 200",
    f"select vec_id as id, row_number() over (order by score desc, vec_id) as r from ({_TOP.replace('top * 0.2', 'top * 0.6')}) q where vec_id in {_ALLOWED}",
)
_BODY["search_indexed"] = f"select * from ({_INDEXED}) q where rank <= 25"
_NEAR = _BODY["near_duplicate_groups"].strip()
_BODY["near_group_bytes"] = _NEAR[: _NEAR.rindex("\nselect seed")] + ", g as (" + _NEAR[_NEAR.rindex("\nselect seed") :] + ") select g.seed, count(*) as n, sum(p.bytes)::bigint as bytes from g join v_photo p on p.id = g.member group by g.seed"

SQL = {name: with_views(body) for name, body in _BODY.items()}
