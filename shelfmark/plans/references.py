"""The registered queries stated in SQL over the same tables.

Written from the meaning of each query, by other means than the Spark code
wherever SQL offers them, so that agreement says something.
"""

from __future__ import annotations

import mimetypes

from .queries import AT, type_names

# What is expected of the engine's tables, stated here once more.  MIME types of
# the fixtures by number of suffix; other types as Python's own guess has them.
_TYPES = {
    0: "image/jpeg",
    1: "text/plain",
    2: "application/pdf",
    4: "video/mp4",
    5: "audio/mpeg",
    6: "application/zip",
    7: "text/x-python",
    12: "application/octet-stream",
    13: "application/x-tar",
}

_CATEGORIES = """
CASE lower({ext})
  WHEN '.jpg' THEN 'Image' WHEN '.jpeg' THEN 'Image' WHEN '.png' THEN 'Image' WHEN '.gif' THEN 'Image'
  WHEN '.bmp' THEN 'Image' WHEN '.tif' THEN 'Image' WHEN '.tiff' THEN 'Image' WHEN '.webp' THEN 'Image'
  WHEN '.heic' THEN 'Image' WHEN '.svg' THEN 'Image' WHEN '.ico' THEN 'Image' WHEN '.raw' THEN 'Image'
  WHEN '.cr2' THEN 'Image' WHEN '.nef' THEN 'Image' WHEN '.dng' THEN 'Image'
  WHEN '.mp4' THEN 'Video' WHEN '.mkv' THEN 'Video' WHEN '.avi' THEN 'Video' WHEN '.mov' THEN 'Video'
  WHEN '.wmv' THEN 'Video' WHEN '.flv' THEN 'Video' WHEN '.webm' THEN 'Video' WHEN '.m4v' THEN 'Video'
  WHEN '.mpg' THEN 'Video' WHEN '.mpeg' THEN 'Video' WHEN '.3gp' THEN 'Video'
  WHEN '.mp3' THEN 'Audio' WHEN '.wav' THEN 'Audio' WHEN '.flac' THEN 'Audio' WHEN '.aac' THEN 'Audio'
  WHEN '.ogg' THEN 'Audio' WHEN '.wma' THEN 'Audio' WHEN '.m4a' THEN 'Audio' WHEN '.opus' THEN 'Audio'
  WHEN '.epub' THEN 'Book' WHEN '.mobi' THEN 'Book' WHEN '.azw' THEN 'Book' WHEN '.azw3' THEN 'Book' WHEN '.fb2' THEN 'Book'
  WHEN '.pdf' THEN 'Document' WHEN '.doc' THEN 'Document' WHEN '.docx' THEN 'Document' WHEN '.odt' THEN 'Document'
  WHEN '.rtf' THEN 'Document' WHEN '.txt' THEN 'Document' WHEN '.md' THEN 'Document'
  WHEN '.xls' THEN 'Spreadsheet' WHEN '.xlsx' THEN 'Spreadsheet' WHEN '.ods' THEN 'Spreadsheet' WHEN '.csv' THEN 'Spreadsheet'
  WHEN '.ppt' THEN 'Presentation' WHEN '.pptx' THEN 'Presentation' WHEN '.odp' THEN 'Presentation'
  WHEN '.zip' THEN 'Archive' WHEN '.rar' THEN 'Archive' WHEN '.7z' THEN 'Archive' WHEN '.tar' THEN 'Archive'
  WHEN '.gz' THEN 'Archive' WHEN '.bz2' THEN 'Archive' WHEN '.xz' THEN 'Archive'
  WHEN '.exe' THEN 'Executable' WHEN '.msi' THEN 'Executable' WHEN '.bat' THEN 'Executable' WHEN '.cmd' THEN 'Executable'
  WHEN '.sh' THEN 'Executable'
  WHEN '.py' THEN 'Code' WHEN '.js' THEN 'Code' WHEN '.ts' THEN 'Code' WHEN '.java' THEN 'Code' WHEN '.c' THEN 'Code'
  WHEN '.cpp' THEN 'Code' WHEN '.cs' THEN 'Code' WHEN '.go' THEN 'Code' WHEN '.rs' THEN 'Code' WHEN '.html' THEN 'Code'
  WHEN '.css' THEN 'Code' WHEN '.json' THEN 'Code' WHEN '.xml' THEN 'Code' WHEN '.yaml' THEN 'Code' WHEN '.yml' THEN 'Code'
  ELSE 'Other' END"""

# -- tables -------------------------------------------------------------------

# the files after a rescan, with and without those that are gone: new and changed
# files have the hash of the listing, the others keep theirs
_FINAL = """
, seen AS (
  SELECT f.disk_id, f.path, f.size_bytes,
    CASE WHEN p.size_bytes = f.size_bytes AND p.modified_date = f.modified_date THEN p.hash ELSE f.hash END AS hash
  FROM files f LEFT JOIN prior p ON p.disk_id = f.disk_id AND p.path = f.path),
final_seen AS (SELECT * FROM seen),
final AS (
  SELECT * FROM seen UNION ALL
  SELECT disk_id, path, size_bytes, hash FROM prior p
  WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.disk_id = p.disk_id AND f.path = p.path))
"""

_FILES = r"""
named AS (
  SELECT *, 'doc_' || doc_id || CASE doc_id % 14
      WHEN 0 THEN '.jpg' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' WHEN 3 THEN '.epub' WHEN 4 THEN '.mp4'
      WHEN 5 THEN '.mp3' WHEN 6 THEN '.zip' WHEN 7 THEN '.py' WHEN 8 THEN '.xlsx' WHEN 9 THEN ''
      WHEN 10 THEN '.xyz123' WHEN 11 THEN '.pptx' WHEN 12 THEN '.exe' ELSE '.tar.gz' END AS filename
  FROM documents),
files AS (
  SELECT doc_id, 1 + doc_id % 3 AS disk_id, 1 + doc_id % 2 AS scan_id,
    'D:\Archive\' || source || '\' || lang || '\' || filename AS path,
    filename,
    CASE doc_id % 14
      WHEN 0 THEN '.jpg' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' WHEN 3 THEN '.epub' WHEN 4 THEN '.mp4'
      WHEN 5 THEN '.mp3' WHEN 6 THEN '.zip' WHEN 7 THEN '.py' WHEN 8 THEN '.xlsx' WHEN 9 THEN ''
      WHEN 10 THEN '.xyz123' WHEN 11 THEN '.pptx' WHEN 12 THEN '.exe' ELSE '.gz' END AS extension,
    CAST(strlen(text) AS BIGINT) AS size_bytes,
    TIMESTAMP '2023-01-01' + to_seconds(doc_id * 3701) AS created_date,
    TIMESTAMP '2024-01-01' + to_seconds(doc_id * 3701) AS modified_date,
    CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS hash,
    CASE WHEN doc_id % 11 <> 0 THEN 'sha256' END AS hash_algo,
    CASE doc_id % 14 {mime} END AS mime_type,
    TIMESTAMP '2024-03-01' + to_seconds(doc_id) AS last_seen,
    text
  FROM named)""".replace(
    "{mime}",
    " ".join(f"WHEN {i} THEN '{kind}'" for i, kind in _TYPES.items()),
)

_ORDERS = r"""
ordered AS (
  SELECT 1 + o_custkey % 4 AS disk_id, 1 + o_custkey % 50 AS scan_id,
    'E:\Orders\' || year(o_orderdate) || '\' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0')
      || '\order_' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.pdf' END AS path,
    'order_' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.pdf' END AS filename,
    CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.pdf' END AS extension,
    o_custkey * o_custkey * 1009 AS size_bytes,
    o_orderdate AS modified_date,
    md5(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS hash
  FROM orders)"""

_PRIOR = r"""
prior AS (
  SELECT disk_id, CAST(1 AS BIGINT) AS scan_id,
    CASE WHEN doc_id % 9 = 0 THEN replace(path, 'D:\Archive\', 'D:\Gone\') ELSE path END AS path,
    filename, extension, size_bytes + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size_bytes,
    created_date, modified_date, 'kept:' || hash AS hash, hash_algo, mime_type, last_seen
  FROM files)"""

_DISKS = r"""
disks AS (
  SELECT s_suppkey + 1 AS disk_id, printf('%016X', s_suppkey) AS volume_serial,
    CASE s_suppkey % 5 WHEN 3 THEN '' WHEN 4 THEN NULL ELSE s_name END AS label,
    CASE s_suppkey % 3 WHEN 0 THEN 'NTFS' WHEN 1 THEN 'exFAT' ELSE 'FAT32' END AS filesystem,
    (s_suppkey + 1) * 1000000007 AS total_bytes,
    TIMESTAMP '2023-01-01' + to_days(CAST(s_suppkey AS INTEGER)) AS first_seen,
    CASE WHEN s_suppkey % 3 <> 0 THEN TIMESTAMP '2023-02-01' + to_days(CAST(s_suppkey AS INTEGER)) END AS last_scanned,
    CASE WHEN s_nationkey % 2 = 0 THEN 'rack ' || s_nationkey END AS description
  FROM supplier)"""

_VOLUMES = r"""
volumes AS (
  SELECT printf('%016X', c_custkey) AS volume_serial, c_name AS label,
    CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS filesystem, c_custkey * 1000003 AS total_bytes
  FROM customer)"""

_PATCHES = r"""
patches AS (
  SELECT o_orderkey AS seq, 1 + o_custkey AS disk_id,
    CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 <= 2
      THEN ' ' || chr(9) || chr(160) || 'disk ' || o_orderkey || chr(8195) || ' ' || chr(10) END AS label,
    CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 <= 2 THEN 'disk ' || o_orderkey END AS clean_label,
    CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 <= 3 THEN o_orderpriority END AS description
  FROM orders)"""

_SCANS = r"""
scans AS (
  SELECT 1 + o_orderkey AS scan_id, 1 + o_custkey % 40 AS disk_id, 'E:\Orders\' || year(o_orderdate) AS root_path,
    o_orderdate AS started_at,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS finished_at,
    CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
    o_custkey AS files_scanned, o_custkey % 3 AS files_failed
  FROM orders)"""

_EVENTS = r"""
listed AS (
  SELECT 1 + user_id % 60 AS scan_id, 'G:\events\' || event_id AS path,
    CASE WHEN event_type = 'error' THEN 'unreadable ' || props END AS error_message, ts AS occurred_at
  FROM events)"""

_TABLES = {
    "files": [_FILES],
    "ordered": [_ORDERS],
    "prior": [_FILES, _PRIOR],
    "disks": [_DISKS],
    "volumes": [_VOLUMES],
    "patches": [_PATCHES],
    "scans": [_SCANS],
    "listed": [_EVENTS],
}


def over(names: str, body: str) -> str:
    """``body`` over the tables named, each stated once."""
    parts: list[str] = []
    for name in names.split():
        parts += [p for p in _TABLES[name] if p not in parts]
    return "WITH " + ",".join(parts) + "\n" + body.strip()


# -- expressions --------------------------------------------------------------


def category(ext: str) -> str:
    return _CATEGORIES.replace("{ext}", ext)


def readable(n: str) -> str:
    steps = [f"WHEN {n} < 1024 THEN {n} || ' B'"]
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        steps.append(f"WHEN {n} < {1024 ** (power + 1)} THEN printf('%.1f {unit}', ({n}) / {float(1024**power)!r}::DOUBLE)")
    return f"CASE {' '.join(steps)} ELSE printf('%.1f PB', ({n}) / {float(1024**5)!r}::DOUBLE) END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HIT = "disk_id, path, filename, extension, size_bytes, modified_date, hash"
_NEWEST = "ORDER BY modified_date DESC NULLS LAST, path, disk_id"
_PLACE = f"row_number() OVER ({_NEWEST}) AS position"
_LISTING = f"""filename AS name, path, coalesce(extension, '') AS extension, {category('extension')} AS category,
  size_bytes, {readable('size_bytes')} AS size_human, modified_date"""
_FOLDER = r"regexp_replace(path, '\\[^\\]*$', '')"


def _facets(rows: str) -> str:
    return f"""
, listing AS ({rows}),
counts AS (SELECT {category('extension')} AS category, count(*) AS n FROM listing GROUP BY 1),
facets AS (
  SELECT 0 AS position, 'All' AS category, CAST(sum(n) AS BIGINT) AS file_count FROM counts
  UNION ALL
  SELECT row_number() OVER (ORDER BY category), category, n FROM counts)
SELECT CAST(position AS BIGINT) AS position, category, file_count FROM facets WHERE (SELECT count(*) FROM counts) >= 2"""


def _rollup(table: str) -> str:
    return rf"""
SELECT disk_id, array_to_string(list_slice(parts, 1, n), '\') AS folder, count(*) AS file_count,
  CAST(sum(size_bytes) AS BIGINT) AS total_bytes
FROM (SELECT disk_id, size_bytes, string_split(path, '\') AS parts,
        unnest(range(1, len(string_split(path, '\')))) AS n FROM {table})
GROUP BY ALL"""


_EXPORT = """
SELECT f.disk_id, d.label AS disk_label, f.path, f.filename, f.extension, f.size_bytes, f.created_date,
  f.modified_date, f.hash, f.mime_type
FROM files f JOIN disks d ON d.disk_id = f.disk_id"""

_REPORT = rf"""
SELECT coalesce(nullif(d.label, ''), CAST(f.disk_id AS VARCHAR)) AS "Disk", {_FOLDER} AS "Folder", filename AS "Filename",
  coalesce(extension, '') AS "Extension", {category('extension')} AS "Category", size_bytes AS "Size (bytes)",
  {readable('size_bytes')} AS "Size", strftime(created_date, '%Y-%m-%dT%H:%M:%S+00:00') AS "Created",
  strftime(modified_date, '%Y-%m-%dT%H:%M:%S+00:00') AS "Modified", coalesce(hash, '') AS "Hash"
FROM files f JOIN disks d ON d.disk_id = f.disk_id"""

_HEADINGS = ["Disk", "Folder", "Filename", "Extension", "Category", "Size (bytes)", "Size", "Created", "Modified", "Hash"]
_WIDTHS = " UNION ALL ".join(
    f"""SELECT CAST({i} AS BIGINT) AS position, '{h}' AS heading,
  CAST(least(greatest(greatest(max(length(CAST("{h}" AS VARCHAR))), {len(h)}) + 2, 10), 80) AS BIGINT) AS width FROM report"""
    for i, h in enumerate(_HEADINGS)
)

def _mime() -> str:
    names = type_names()
    guess = mimetypes.MimeTypes(filenames=()).guess_type
    options = " ".join(f"WHEN {i} THEN {quoted(n)}" for i, n in enumerate(names))
    types = " ".join(f"WHEN {i} THEN {quoted(kind)}" for i, n in enumerate(names) if (kind := guess("doc0" + n)[0]))
    return f"""
SELECT doc_id, 'doc' || doc_id || CASE doc_id % {len(names)} {options} END AS filename,
  CASE doc_id % {len(names)} {types} END AS mime_type FROM documents"""


# -- queries ------------------------------------------------------------------


def references() -> dict[str, str]:
    sampled = "unhex(printf('%016X', size_bytes)) || b[1:1024] || CASE WHEN size_bytes > 1024 THEN b[size_bytes - 1023:size_bytes] ELSE ''::BLOB END"
    small_hash = f"CASE WHEN size_bytes <= 4096 THEN sha256(b) ELSE sha256({sampled}) END"
    small_algo = "CASE WHEN size_bytes <= 4096 THEN 'sha256' ELSE 'sha256-sampled' END"
    at = f"TIMESTAMP '{AT}'"
    return {
        # search
        "search_name": over("files", f"SELECT {_HIT}, {_PLACE} FROM files WHERE lower(filename) LIKE '%oc_1%2%' {_NEWEST} LIMIT 200"),
        "search_ext": over("files", f"SELECT {_HIT}, {_PLACE} FROM files WHERE extension = '.txt' {_NEWEST} LIMIT 200"),
        "search_size": over(
            "files", f"SELECT {_HIT}, {_PLACE} FROM files WHERE size_bytes BETWEEN 1000 AND 4000 {_NEWEST} LIMIT 200"
        ),
        "search_modified": over(
            "files",
            f"""SELECT {_HIT} FROM files WHERE modified_date >= TIMESTAMP '2024-01-02'
                AND modified_date <= TIMESTAMP '2024-01-20 04:00:00' {_NEWEST} LIMIT 200""",
        ),
        "search_disk_scan": over("ordered", f"SELECT {_HIT} FROM ordered WHERE disk_id = 2 AND scan_id = 14"),
        "search_combined": over(
            "ordered",
            f"""SELECT {_HIT}, {_PLACE} FROM ordered WHERE filename LIKE '%order_1%' AND filename LIKE '%.pdf'
                AND size_bytes >= 1009 AND disk_id = 3 AND modified_date >= TIMESTAMP '1996-01-01' {_NEWEST} LIMIT 500""",
        ),
        "search_everything": over("ordered", f"SELECT {_HIT} FROM ordered"),
        "search_listing": over(
            "files", f"SELECT {_LISTING}, {_PLACE} FROM files WHERE disk_id = 2 AND contains(lower(filename), 'doc') {_NEWEST} LIMIT 200"
        ),
        "category_filter": over(
            "files", f"SELECT {_LISTING} FROM files WHERE {category('extension')} = 'Archive'"
        ),
        "category_filter_other": over(
            "files", f"SELECT {_LISTING} FROM files WHERE {category('extension')} = 'Other'"
        ),
        "category_facets": over("files", _facets("SELECT extension FROM files")),
        "category_facets_search": over(
            "files", _facets(f"SELECT extension FROM files WHERE disk_id = 1 {_NEWEST} LIMIT 200")
        ),
        "category_facets_single": over("ordered", _facets("SELECT extension FROM ordered")),
        "path_known": over(
            "files",
            r"""SELECT r.path, r.path IN (SELECT path FROM files) AS known
                FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN replace(path, 'D:\Archive\', 'D:\Missing\') ELSE path END
                      AS path FROM files) r""",
        ),
        # duplicates
        "duplicates_found": over(
            "ordered",
            """SELECT hash, count(*) AS copies, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM ordered
               WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1 ORDER BY total_bytes DESC, hash LIMIT 200""",
        ),
        "duplicates_all": over(
            "files",
            """SELECT hash, count(*) AS copies, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM files
               WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1""",
        ),
        "duplicate_members": over(
            "ordered",
            """SELECT hash, count(*) OVER same AS copies, CAST(sum(size_bytes) OVER same AS BIGINT) AS total_bytes,
                 disk_id, path, filename, size_bytes, modified_date
               FROM ordered WHERE hash IS NOT NULL WINDOW same AS (PARTITION BY hash) QUALIFY count(*) OVER same > 1""",
        ),
        "duplicate_members_top": over(
            "files",
            """, g AS (SELECT hash, count(*) AS copies, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM files
               WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1 ORDER BY total_bytes DESC, hash LIMIT 50)
               SELECT f.hash, copies, total_bytes, disk_id, path, filename, size_bytes, modified_date
               FROM files f JOIN g ON g.hash = f.hash""",
        ),
        "files_for_hash": over(
            "files",
            """SELECT disk_id, path, filename, size_bytes, modified_date FROM files
               WHERE hash = (SELECT hash FROM files WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1
                             ORDER BY sum(size_bytes) DESC, hash LIMIT 1)""",
        ),
        # statistics
        "catalog_totals": over(
            "ordered", "SELECT count(*) AS file_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM ordered"
        ),
        "disk_stats": over(
            "disks ordered",
            """SELECT d.disk_id, d.label, d.volume_serial, count(f.path) AS file_count,
                 CAST(coalesce(sum(f.size_bytes), 0) AS BIGINT) AS total_bytes
               FROM disks d LEFT JOIN ordered f ON f.disk_id = d.disk_id GROUP BY 1, 2, 3""",
        ),
        "disk_list": over(
            "disks files",
            f""", s AS (SELECT d.disk_id, d.label, d.description, d.volume_serial, count(f.path) AS file_count,
                 CAST(coalesce(sum(f.size_bytes), 0) AS BIGINT) AS total_bytes
               FROM disks d LEFT JOIN files f ON f.disk_id = d.disk_id GROUP BY 1, 2, 3, 4)
               SELECT disk_id, CASE WHEN label IS NULL OR label = '' THEN '(unlabeled)' ELSE label END AS label,
                 coalesce(description, '') AS description, volume_serial, file_count, total_bytes,
                 {readable('total_bytes')} AS size_human FROM s""",
        ),
        # folders
        "descendants": over(
            "ordered",
            r"""SELECT disk_id, path, size_bytes, modified_date FROM ordered
                WHERE disk_id = 4 AND split_part(path, '\', 2) = 'Orders' AND split_part(path, '\', 3) = '1996'""",
        ),
        "browse_folders": over(
            "ordered",
            rf""", g AS (SELECT split_part(path, '\', 3) AS name, count(*) AS file_count,
                   CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM ordered WHERE disk_id = 2 GROUP BY 1)
                SELECT name, 'e:\ORDERS\' || name AS path, file_count, total_bytes,
                  {readable('total_bytes')} AS size_human FROM g""",
        ),
        "browse_files": over(
            "files",
            rf"""SELECT {_LISTING}, hash FROM files WHERE disk_id = 1 AND {_FOLDER} = 'D:\Archive\src0\en'""",
        ),
        "browse_root_folders": over(
            "ordered",
            rf""", g AS (SELECT split_part(path, '\', 3) AS name, count(*) AS file_count,
                   CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM ordered WHERE disk_id = 1 GROUP BY 1)
                SELECT name, 'E:\Orders\' || name AS path, file_count, total_bytes,
                  {readable('total_bytes')} AS size_human FROM g""",
        ),
        "browse_root_files": rf"""
            SELECT event_type || '_' || event_id || '.log' AS name,
              '\\server\share\logs\' || event_type || '_' || event_id || '.log' AS path, '.log' AS extension,
              'Other' AS category, user_id * 1000 AS size_bytes, {readable('user_id * 1000')} AS size_human,
              ts AS modified_date, md5(props) AS hash FROM events WHERE event_id % 2 = 0""",
        "browse_root_location": over(
            "files",
            r"""SELECT DISTINCT CAST(1 AS BIGINT) AS disk_id, 'D:\Archive' AS current_path, 'D:' AS parent_path
                FROM files WHERE disk_id = 1""",
        ),
        "browse_top": over(
            "prior",
            rf""", g AS (SELECT split_part(path, '\', 2) AS name, count(*) AS file_count,
                   CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM prior WHERE disk_id = 1 GROUP BY 1)
                SELECT name, 'D:\' || name AS path, file_count, total_bytes,
                  {readable('total_bytes')} AS size_human FROM g""",
        ),
        "folder_rollup": over("ordered", _rollup("ordered")),
        "folder_rollup_documents": over("files", _rollup("files")),
        # scalar functions
        "path_functions": over(
            "files",
            rf"""SELECT path, extension AS suffix, {_FOLDER} AS folder,
                  CAST(len(string_split(path, '\')) AS BIGINT) AS depth, split_part(path, '\', 3) AS third,
                  regexp_replace({_FOLDER}, '\\[^\\]*$', '') AS above, CAST(NULL AS VARCHAR) AS above_drive FROM files""",
        ),
        "ancestor_folders": over(
            "ordered",
            r"""SELECT path, CAST(n - 1 AS BIGINT) AS level, split_part(path, '\', CAST(n AS INTEGER)) AS label,
                  array_to_string(list_slice(string_split(path, '\'), 1, n), '\') AS folder
                FROM (SELECT path, unnest(range(1, len(string_split(path, '\')) + 1)) AS n FROM ordered)""",
        ),
        "url_paths": r"""
            WITH parts AS (SELECT url, string_split(trim(regexp_replace(url, '/+', '/', 'g'), '/'), '/') AS p FROM pages)
            SELECT url, lower(regexp_extract(url, '^.+(\.[^.]+)$', 1)) AS suffix, CAST(len(p) AS BIGINT) AS depth,
              regexp_replace(url, '/[^/]*$', '') AS folder,
              CASE WHEN len(p) > 1 THEN array_to_string(list_slice(p, 1, len(p) - 1), '/') END AS above FROM parts""",
        "size_functions": over(
            "ordered",
            f"""SELECT path, {readable('size_bytes')} AS as_is, {readable('size_bytes * 1000')} AS thousandfold,
                  {readable('size_bytes * 1000000')} AS millionfold, {readable('size_bytes % 3000')} AS below FROM ordered""",
        ),
        "document_sizes": f"SELECT doc_id, {readable('CAST(strlen(text) AS BIGINT) * 128')} AS size_human FROM documents",
        "mime_types": _mime(),
        "categories": over(
            "files",
            f"""SELECT path, {category('extension')} AS category, {category('extension')} AS category_upper,
                  {category("nullif(extension, '')")} AS category_null FROM files""",
        ),
        "display_functions": over(
            "files",
            """SELECT path, left(hash, 16) AS short_hash, strftime(modified_date, '%Y-%m-%d %H:%M:%S') AS shown,
                 CASE WHEN hash IS NULL THEN '' ELSE strftime(created_date, '%Y-%m-%d %H:%M:%S') END AS shown_or_blank,
                 coalesce(hash, '') AS hash_or_blank,
                 strftime(modified_date, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM files""",
        ),
        "strip_labels": over("patches", "SELECT seq, clean_label AS label FROM patches"),
        # rescans
        "change_kinds": over(
            "prior",
            """SELECT f.disk_id, f.path, f.size_bytes,
                 CASE WHEN p.path IS NULL THEN 'new'
                      WHEN p.size_bytes = f.size_bytes AND p.modified_date = f.modified_date THEN 'unchanged'
                      ELSE 'changed' END AS change_kind,
                 CASE WHEN p.size_bytes = f.size_bytes AND p.modified_date = f.modified_date THEN p.hash END AS hash,
                 CASE WHEN p.size_bytes = f.size_bytes AND p.modified_date = f.modified_date THEN p.hash_algo END AS hash_algo
               FROM files f LEFT JOIN prior p ON p.disk_id = f.disk_id AND p.path = f.path""",
        ),
        "hash_reuse": over(
            "prior",
            f""", incoming AS (SELECT *, encode(text) AS b FROM files), j AS (
               SELECT i.disk_id, i.path, i.size_bytes, i.b, p.hash, p.hash_algo,
                 CASE WHEN p.path IS NULL THEN 'new'
                      WHEN p.size_bytes = i.size_bytes AND p.modified_date = i.modified_date THEN 'unchanged'
                      ELSE 'changed' END AS change_kind
               FROM incoming i LEFT JOIN prior p ON p.disk_id = i.disk_id AND p.path = i.path)
               SELECT disk_id, path, change_kind,
                 CASE WHEN change_kind = 'unchanged' THEN hash ELSE {small_hash} END AS hash,
                 CASE WHEN change_kind = 'unchanged' THEN hash_algo ELSE {small_algo} END AS hash_algo FROM j""",
        ),
        "hash_reuse_blake2b": over(
            "prior",
            f""", incoming AS (SELECT *, encode(text) AS b FROM files), j AS (
               SELECT i.size_bytes, i.b, p.hash, p.hash_algo,
                 CASE WHEN p.path IS NULL THEN 'new'
                      WHEN p.size_bytes = i.size_bytes AND p.modified_date = i.modified_date THEN 'unchanged'
                      ELSE 'changed' END AS change_kind
               FROM incoming i LEFT JOIN prior p ON p.disk_id = i.disk_id AND p.path = i.path),
               k AS (SELECT change_kind, CASE WHEN change_kind = 'unchanged' THEN hash END AS kept_hash,
                 CASE WHEN change_kind <> 'unchanged' THEN {small_hash} END AS made_hash,
                 CASE WHEN change_kind = 'unchanged' THEN hash_algo WHEN size_bytes <= 4096 THEN 'blake2b'
                   ELSE 'blake2b-sampled' END AS hash_algo FROM j)
               SELECT change_kind, hash_algo, kept_hash, count(*) AS files FROM k
               GROUP BY change_kind, hash_algo, kept_hash, made_hash""",
        ),
        "listing_match": over(
            "prior",
            """SELECT coalesce(f.disk_id, p.disk_id) AS disk_id, coalesce(f.path, p.path) AS path,
                 CASE WHEN f.path IS NULL THEN 'unseen' WHEN p.path IS NULL THEN 'new'
                      WHEN p.size_bytes = f.size_bytes AND p.modified_date = f.modified_date THEN 'unchanged'
                      ELSE 'changed' END AS change_kind, f.size_bytes, p.size_bytes AS old_size, p.hash AS old_hash
               FROM files f FULL JOIN prior p ON p.disk_id = f.disk_id AND p.path = f.path""",
        ),
        "catalog_upsert": over(
            "prior",
            """SELECT disk_id, CAST(2 AS BIGINT) AS scan_id, path, filename, extension, size_bytes, created_date,
                 modified_date, hash, hash_algo, mime_type, last_seen FROM files
               UNION ALL
               SELECT disk_id, scan_id, path, filename, extension, size_bytes, created_date, modified_date, hash,
                 hash_algo, mime_type, last_seen FROM prior p
               WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.disk_id = p.disk_id AND f.path = p.path)""",
        ),
        "rollup_maintained": over("prior", f"{_FINAL} {_rollup('final')}"),
        "rollup_after_moves": over("prior", f"{_FINAL} {_rollup('final_seen')}"),
        "duplicates_maintained": over(
            "prior",
            f"""{_FINAL} SELECT hash, count(*) AS copies, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM final_seen
                WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1""",
        ),
        "duplicate_group_changes": over(
            "prior",
            f"""{_FINAL}, was AS (SELECT hash, count(*) AS n FROM prior WHERE hash IS NOT NULL GROUP BY hash),
                 now AS (SELECT hash, count(*) AS n FROM final_seen WHERE hash IS NOT NULL GROUP BY hash),
                 both_ AS (SELECT hash, coalesce(was.n, 0) AS a, coalesce(now.n, 0) AS b FROM was FULL JOIN now USING (hash))
                SELECT hash, a AS copies_before, b AS copies,
                  CASE WHEN a < 2 THEN 'entered' WHEN b < 2 THEN 'left' WHEN b > a THEN 'grew' ELSE 'shrank' END AS change
                FROM both_ WHERE a <> b AND (a > 1 OR b > 1)""",
        ),
        "folder_intervals": over(
            "ordered",
            rf""", totals AS ({_rollup('ordered')}),
                 placed AS (SELECT *, row_number() OVER (ORDER BY disk_id, folder || '\') AS first FROM totals)
                SELECT p.disk_id, p.folder, p.first, p.first + (SELECT count(*) FROM totals t
                    WHERE t.disk_id = p.disk_id AND starts_with(t.folder, p.folder || '\')) AS last,
                  p.file_count, p.total_bytes FROM placed p""",
        ),
        "below_by_interval": over(
            "ordered",
            r"SELECT disk_id, path, size_bytes, modified_date FROM ordered WHERE disk_id = 4 AND starts_with(path, 'E:\Orders\1996\')",
        ),
        "search_by_name_index": over(
            "ordered", "SELECT disk_id, path, filename FROM ordered WHERE lower(filename) LIKE '%r_123%'"
        ),
        "search_by_name_index_pieces": over(
            "files", "SELECT disk_id, path, filename FROM files WHERE contains(lower(filename), '9.txt')"
        ),
        "newest_page": over(
            "ordered",
            f"SELECT disk_id, path, modified_date, {_PLACE} FROM ordered {_NEWEST} LIMIT 300",
        ),
        "newest_page_after": over(
            "ordered",
            rf"""SELECT disk_id, path, modified_date, {_PLACE} FROM ordered
                WHERE modified_date < TIMESTAMP '1996-07-01' OR (modified_date = TIMESTAMP '1996-07-01'
                  AND (path > 'E:\Orders\1996\07\order_2' OR (path = 'E:\Orders\1996\07\order_2' AND disk_id > 2)))
                {_NEWEST} LIMIT 250""",
        ),
        "equal_by_need": over(
            "files",
            """SELECT doc_id, disk_id, path, size_bytes, sha256(text) AS hash FROM files
               QUALIFY count(*) OVER (PARTITION BY text) > 1""",
        ),
        "upsert_batch": r"""
            WITH incoming AS (
              SELECT 1 + l_orderkey % 3 AS disk_id, l_suppkey AS scan_id,
                'F:\li\' || l_orderkey || '\' || l_linenumber || '.dat' AS path, l_linenumber || '.dat' AS filename,
                '.dat' AS extension, CAST(l_quantity AS BIGINT) AS size_bytes, l_shipdate AS created_date,
                l_shipdate AS modified_date, CAST(l_partkey AS VARCHAR) AS hash,
                'none' AS hash_algo, CAST(NULL AS VARCHAR) AS mime_type, l_shipdate AS last_seen,
                row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey DESC,
                  CAST(l_quantity AS BIGINT) DESC, CAST(l_partkey AS VARCHAR) DESC) AS nth
              FROM lineitem)
            SELECT * EXCLUDE (nth) FROM incoming WHERE nth = 1
            UNION ALL
            SELECT 1 + o_orderkey % 3, 0, 'F:\li\' || o_orderkey || '\1.dat', '1.dat', '.dat', 0, o_orderdate, o_orderdate,
              NULL, NULL, NULL, o_orderdate FROM orders o
            WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1)""",
        "upsert_last_wins": r"""
            SELECT disk_id, path, size_bytes, last_seen FROM (
              SELECT 1 + l_orderkey % 3 AS disk_id, 'F:\li\' || l_orderkey || '\' || l_linenumber || '.dat' AS path,
                CAST(l_quantity AS BIGINT) AS size_bytes, l_shipdate AS last_seen,
                row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS nth
              FROM lineitem) WHERE nth = 1""",
        # disks, scans, errors
        "disk_upsert": over(
            "disks volumes",
            f"""SELECT d.disk_id, d.volume_serial, d.label,
                  CASE WHEN v.volume_serial IS NULL THEN d.filesystem ELSE v.filesystem END AS filesystem,
                  CASE WHEN v.volume_serial IS NULL THEN d.total_bytes ELSE v.total_bytes END AS total_bytes,
                  d.first_seen, CASE WHEN v.volume_serial IS NULL THEN d.last_scanned ELSE {at} END AS last_scanned,
                  d.description
                FROM disks d LEFT JOIN volumes v ON v.volume_serial = d.volume_serial
                UNION ALL
                SELECT (SELECT max(disk_id) FROM disks) + row_number() OVER (ORDER BY md5(volume_serial), volume_serial),
                  volume_serial, label, filesystem, total_bytes, {at}, {at}, NULL
                FROM volumes WHERE volume_serial NOT IN (SELECT volume_serial FROM disks)""",
        ),
        "disk_patch": over(
            "disks patches",
            """SELECT d.disk_id, d.volume_serial, coalesce(
                 (SELECT arg_max(clean_label, seq) FROM patches p WHERE p.disk_id = d.disk_id AND p.label IS NOT NULL),
                 d.label) AS label, d.filesystem, d.total_bytes, d.first_seen, d.last_scanned, coalesce(
                 (SELECT arg_max(description, seq) FROM patches p WHERE p.disk_id = d.disk_id AND p.description IS NOT NULL),
                 d.description) AS description FROM disks d""",
        ),
        "disk_patch_unknown": over(
            "disks patches",
            "SELECT seq, disk_id, label, description FROM patches WHERE disk_id NOT IN (SELECT disk_id FROM disks)",
        ),
        "disks_v1_as_v2": over(
            "disks",
            """SELECT disk_id, volume_serial, label, filesystem, total_bytes, first_seen, last_scanned,
                 CAST(NULL AS VARCHAR) AS description FROM disks""",
        ),
        "scan_close_stale": over("scans", f"SELECT * REPLACE ({_stale('disk_id = 7', at)}) FROM scans"),
        "scan_close_stale_disks": over(
            "scans disks", f"SELECT * REPLACE ({_stale('disk_id IN (SELECT disk_id FROM disks)', at)}) FROM scans"
        ),
        "scan_open": over(
            "scans",
            rf"""SELECT * REPLACE ({_stale('disk_id = 7', at)}) FROM scans
                 UNION ALL SELECT 0, 7, 'E:\Orders', {at}, NULL, 'running', 0, 0""",
        ),
        "scan_finish": over(
            "scans",
            f"""SELECT scan_id, disk_id, root_path, started_at, CASE WHEN scan_id = 12 THEN {at} ELSE finished_at END AS finished_at,
                  CASE WHEN scan_id = 12 THEN 'completed' ELSE status END AS status,
                  CASE WHEN scan_id = 12 THEN 345 ELSE files_scanned END AS files_scanned,
                  CASE WHEN scan_id = 12 THEN 6 ELSE files_failed END AS files_failed FROM scans""",
        ),
        "scan_counts": over(
            "ordered listed",
            """SELECT scan_id, CAST(sum(good) AS BIGINT) AS files_scanned, CAST(sum(1 - good) AS BIGINT) AS files_failed FROM (
                 SELECT scan_id, 1 AS good FROM ordered
                 UNION ALL SELECT scan_id, 0 FROM listed WHERE error_message IS NOT NULL) GROUP BY scan_id""",
        ),
        "scan_errors": over("listed", "SELECT * FROM listed WHERE error_message IS NOT NULL"),
        "scan_listed": over("listed", "SELECT scan_id, path, occurred_at FROM listed WHERE error_message IS NULL"),
        # hashes
        "hash_modes": over(
            "files",
            f""", c AS (SELECT doc_id, size_bytes, encode(text) AS b FROM files)
                SELECT doc_id, {small_hash} AS sampled_hash, {small_algo} AS sampled_algo, sha256(b) AS full_hash,
                  'sha256' AS full_algo, CAST(NULL AS VARCHAR) AS no_hash, CAST(NULL AS VARCHAR) AS no_algo FROM c""",
        ),
        "blake2b_groups": """
            SELECT count(*) AS copies, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes
            FROM documents GROUP BY text HAVING count(*) > 1""",
        "blake2b_sampled_groups": f"""
            WITH c AS (SELECT CAST(strlen(text) AS BIGINT) AS size_bytes, encode(text) AS b FROM documents)
            SELECT count(*) AS copies, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM c
            GROUP BY size_bytes > 4096, CASE WHEN size_bytes <= 4096 THEN b ELSE {sampled} END HAVING count(*) > 1""",
        # report and snapshots
        "export_rows": over("files disks", _EXPORT),
        "export_disk": over(
            "ordered disks",
            """SELECT f.disk_id, d.label AS disk_label, f.path, f.filename, f.extension, f.size_bytes,
                 f.modified_date AS created_date, f.modified_date, f.hash, 'application/pdf' AS mime_type
               FROM ordered f JOIN disks d ON d.disk_id = f.disk_id WHERE f.disk_id = 4 AND f.filename LIKE '%.pdf'""",
        ),
        "export_filtered": over(
            "ordered disks",
            """SELECT f.disk_id, d.label AS disk_label, f.path, f.filename, f.extension, f.size_bytes,
                 f.modified_date AS created_date, f.modified_date, f.hash,
                 CASE f.extension WHEN '.txt' THEN 'text/plain' ELSE 'application/pdf' END AS mime_type
               FROM ordered f JOIN disks d ON d.disk_id = f.disk_id WHERE f.size_bytes >= 1""",
        ),
        "export_first": over(
            "files disks",
            f"""SELECT *, row_number() OVER (ORDER BY path, disk_id) AS position FROM ({_EXPORT})
                ORDER BY path, disk_id LIMIT 150""",
        ),
        "report_rows": over("files disks", _REPORT),
        "report_widths": over("files disks", f", report AS ({_REPORT}) {_WIDTHS}"),
        "snapshot_keep": """
            SELECT strftime(ts, '%Y%m%d') AS snapshot, event_id, event_type, value FROM events
            WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) FROM events ORDER BY 1 DESC LIMIT 7)""",
    }


def _stale(which: str, at: str) -> str:
    hit = f"status = 'running' AND {which}"
    return f"CASE WHEN {hit} THEN {at} ELSE finished_at END AS finished_at, CASE WHEN {hit} THEN 'interrupted' ELSE status END AS status"
