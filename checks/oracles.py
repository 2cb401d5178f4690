"""The same results in DuckDB SQL, from the tables alone."""

from __future__ import annotations

from checks.inputs import CREATED_AT, REPORT_TIME, with_views
from tallywright.functions import cells, text
from tallywright.operators.assemble import PAGE_MARK
from tallywright.operators.documents import EXTRACTORS, NO_INSIGHTS, UNKNOWN_TYPE
from tallywright.plans import reports

_SPACE = "".join(rf"\x{{{ord(c):x}}}" for c in text.WHITE_SPACE)


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _fill(template: str, **fields: str) -> str:
    """SQL concatenating a template's fixed parts with expressions."""
    parts = []
    rest = template
    while rest:
        fixed, opened, rest = rest.partition("{")
        if fixed:
            parts.append(_quote(fixed))
        if opened:
            name, _, rest = rest.partition("}")
            parts.append(f"CAST({fields[name]} AS varchar)")
    return "concat(" + ", ".join(parts) + ")"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{_SPACE}]+|[{_SPACE}]+\z', '', 'g')"


# --- statistics -----------------------------------------------------------------


def _stats(
    source: str,
    columns: list[str],
    with_clause: str = "",
    by: str = "",
    mean_digits: int = 4,
) -> str:
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    each = []
    for i, c in enumerate(columns):
        measures = ", ".join(
            f"CASE WHEN count({c}) = 0 THEN 0.0 ELSE round({f}, {d}) END AS {name}"
            for name, f, d in (
                ("mean", f"avg({c})", mean_digits),
                ("median", f"median(CAST({c} AS double))", 4),
                ("min", f"CAST(min({c}) AS double)", 4),
                ("max", f"CAST(max({c}) AS double)", 4),
                ("std", f"stddev_samp({c})", 4),
            )
        )
        each.append(
            f"SELECT {key}{i} AS position, '{c}' AS column_name,"
            f" count({c}) AS n, {measures} FROM {source}{group}"
        )
    return with_clause + " " + " UNION ALL ".join(each)


def _summary(source: str, columns: list[str], with_clause: str) -> str:
    each = []
    for i, c in enumerate(columns):
        quartiles = ", ".join(
            f"round(quantile_cont(CAST({c} AS double), {q}), 4) AS {name}"
            for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
        )
        each.append(
            f"SELECT {i} AS position, '{c}' AS column_name, count({c}) AS count,"
            f" round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,"
            f" round(CAST(min({c}) AS double), 4) AS min, {quartiles},"
            f" round(CAST(max({c}) AS double), 4) AS max FROM {source}"
        )
    return with_clause + " " + " UNION ALL ".join(each)


# --- missing cells ----------------------------------------------------------------

_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
_EVENTS = with_views("events_missing")
_MISSING = " + ".join(f"(count(*) - count({c}))" for c in _EVENT_COLUMNS)
_SHAPE = (
    f"SELECT count(*) AS total_rows,"
    f" CAST({len(_EVENT_COLUMNS)} AS bigint) AS total_columns,"
    f" {_MISSING} AS missing_values FROM events_missing"
)
_MISSING_BY_COLUMN = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name,"
    f" count(*) - count({c}) AS missing_count,"
    f" round((count(*) - count({c})) / count(*) * 100.0, 4) AS missing_pct"
    " FROM events_missing"
    for i, c in enumerate(_EVENT_COLUMNS)
)

# --- types ----------------------------------------------------------------------

_TYPED = {0: ("l_orderkey", "integer"), 1: ("l_quantity", "floating")}
_TYPED[8] = ("l_shipdate", "datetime64")
_TEXT = {2: "t_any", 3: "t_mixed", 4: "t_numbers", 5: "t_flag", 6: "t_day"}
_TEXT[7] = "l_returnflag"


def _class(column: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({column}, '{p}') THEN '{k}'"
        for k, p in cells.CELL_PATTERNS.items()
    )
    return f"CASE WHEN {column} IS NULL THEN NULL {cases} ELSE 'string' END"


def _inferred() -> str:
    rows = [
        f"SELECT {i} AS position, '{c}' AS column_name, '{k}' AS inferred_type"
        for i, (c, k) in _TYPED.items()
    ]
    for i, c in _TEXT.items():
        rows.append(
            f"SELECT {i}, '{c}', CASE WHEN len(k) = 0 THEN 'empty'"
            " WHEN len(k) = 1 THEN k[1]"
            " WHEN len(k) = 2 AND list_contains(k, 'integer')"
            " AND list_contains(k, 'floating') THEN 'mixed-integer-float'"
            " WHEN list_contains(k, 'integer') THEN 'mixed-integer'"
            " ELSE 'mixed' END FROM (SELECT coalesce(list(DISTINCT c)"
            f" FILTER (c IS NOT NULL), []) AS k FROM (SELECT {_class(c)} AS c"
            " FROM lineitem_text))"
        )
    return " UNION ALL ".join(rows)


_LINEITEM_TEXT = with_views("lineitem_text")

# --- documents --------------------------------------------------------------------

_NAMED = with_views("documents_named")
_BUDGET = (
    "CASE length_label "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.SUMMARY_WORDS.items())
    + f" ELSE {text.SUMMARY_WORDS_OTHERWISE} END"
)
_LEAD = (
    "array_to_string(list_slice(regexp_extract_all(text,"
    f" '[^{_SPACE}]+'), 1, {_BUDGET}), ' ')"
)
_SUFFIX = r"regexp_extract(file_name, '[^./](\.[^./]+)$', 1)"
_EXTRACTOR = (
    f"CASE lower({_SUFFIX}) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTRACTORS.items())
    + " END"
)


def _document_reports(order: str, *further: str) -> str:
    content = _fill(
        reports.DOCUMENT,
        title="'Executive'",
        upper="'EXECUTIVE'",
        type="'executive'",
        date=_quote(REPORT_TIME.strftime(reports.DATE_FORMATS["document"])),
        source="file_name",
        summary="text",
        insights=f"coalesce(response, {_quote(NO_INSIGHTS)})",
    )
    return (
        with_views("documents_named", "label_responses")
        + f" SELECT {order}, 'executive' AS report_type,"
        " concat('doc_executive_report_', doc_id, '.md') AS report_name,"
        f" {', '.join([f'{content} AS content', *further])}"
        " FROM documents_named LEFT JOIN label_responses USING (doc_id)"
    )


# --- data reports -------------------------------------------------------------------

# customer's columns as a printed sample shows them
_SHOWN = [
    ("c_custkey", "integer"),
    ("c_name", "text"),
    ("c_nationkey", "integer"),
    ("c_acctbal", "floating"),
    ("c_mktsegment", "text"),
]
_NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal"]


def _sample(rows: int, key: str) -> str:
    """CTE ``sample``: an aligned table of each report's first customers."""
    printed, widths, line, head = [], [], [], []
    for c, kind in _SHOWN:
        sign = f"CASE WHEN {c} < 0 THEN '' ELSE ' ' END"
        shown = {
            "integer": f"{sign} || {c}",
            "text": f"' ' || {c}",
            "floating": f"{sign} || CASE decimals WHEN 1 THEN printf('%.1f', {c})"
            f" ELSE printf('%.2f', {c}) END",
        }[kind]
        title = c if kind == "text" else f" {c}"
        printed.append(f"{shown} AS {c}")
        widths.append(
            f"CAST(greatest({len(title)}, max(length({c})) OVER (PARTITION BY k))"
            f" AS integer) AS w_{c}"
        )
        line.append(f"' ' || lpad({c}, w_{c}, ' ')")
        head.append(f"' ' || lpad('{title}', max(w_{c}), ' ')")
    return f"""
    first AS (SELECT *, {key} AS k,
        row_number() OVER (PARTITION BY {key} ORDER BY c_custkey) - 1 AS i
        FROM customer QUALIFY i < {rows}),
    measured AS (SELECT *, max(CASE WHEN round(c_acctbal, 1) = c_acctbal THEN 1
        ELSE 2 END) OVER (PARTITION BY k) AS decimals FROM first),
    printed AS (SELECT k, i, {', '.join(printed)} FROM measured),
    wide AS (SELECT *, {', '.join(widths)} FROM printed),
    sample AS (SELECT k, ' ' || {' || '.join(head)} || chr(10) ||
        string_agg(i || {' || '.join(line)}, chr(10) ORDER BY i) AS sample
        FROM wide GROUP BY k)"""


def _data_report(report_type: str, key: str = "c_mktsegment") -> str:
    template, head, line, _ = reports._LAYOUTS[report_type]
    measures = {
        "mean": "avg({c})",
        "median": "median(CAST({c} AS double))",
        "min": "CAST(min({c}) AS double)",
        "max": "CAST(max({c}) AS double)",
        "std": "stddev_samp({c})",
    }
    lines = [
        _fill(
            line,
            column=_quote(c),
            **{m: f"printf('%.2f', {f.format(c=c)})" for m, f in measures.items()},
        )
        for c in _NUMERIC
    ]
    total = len(_SHOWN)
    present = " + ".join(f"count({c})" for c, _ in _SHOWN)
    content = _fill(
        template,
        date=_quote(REPORT_TIME.strftime(reports.DATE_FORMATS[report_type])),
        source="k",
        insights=_quote(reports.NO_DATA_INSIGHTS),
        rows="format('{:,}', n)",
        columns=str(total),
        complete=f"printf('%.1f', 100.0 - (n * {total} - present) / (n * {total})"
        " * 100.0)",
        numeric=str(len(_NUMERIC)),
        categorical="2",
        categories="'c_name, c_mktsegment'",
        numbers=f"concat({_quote(head)}, numbers)",
        missing=_quote(reports.NONE_MISSING),
        sample="sample",
    )
    return f"""
    WITH {_sample(reports.SAMPLE_ROWS[report_type], key)},
    figures AS (SELECT {key} AS k, count(*) AS n, {present} AS present,
        concat({', '.join(lines)}) AS numbers FROM customer GROUP BY k)
    SELECT k AS report_key, '{report_type}' AS report_type,
        concat('{report_type}_report_', k, '.md') AS report_name,
        {content} AS content
    FROM figures JOIN sample USING (k)"""


_WITH_TOTALS = "{} SELECT * EXCLUDE (mean), round(mean * n, 4) AS total FROM ({})"
_PAGE, _HTML = PAGE_MARK + "{text}", reports.HTML_PAGE.split("REPORT")
_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_CSV_COLUMNS = "conv_id, turn, role, text"

ALL: dict[str, str] = {
    "load_table": "SELECT * FROM orders",
    "read_text_files": "SELECT item_id, text || chr(10) AS text FROM benchmark",
    "page_concat": with_views("conversation_pages")
    + " SELECT conv_id, string_agg("
    + _fill(_PAGE, page="page", text="text")
    + ", '' ORDER BY page) AS text FROM conversation_pages GROUP BY conv_id",
    "block_concat": "WITH rows_ AS (SELECT conv_id, turn, array_to_string("
    f"list_filter([{_strip('role')}, {_strip('text')}], lambda x: x <> ''), ' | ')"
    " AS line FROM conversations)"
    " SELECT conv_id AS doc_id, coalesce(nullif("
    + _strip("string_agg(line, chr(10) ORDER BY turn) FILTER (line <> '')")
    + ", ''), 'No readable text found in the Word document.') AS text"
    " FROM rows_ GROUP BY conv_id",
    "doc_type": f"{_NAMED} SELECT doc_id, file_name, lower({_SUFFIX}) AS suffix,"
    f" {_EXTRACTOR} AS extractor, CASE WHEN {_SUFFIX} = '' THEN '{UNKNOWN_TYPE}'"
    f" ELSE replace(upper({_SUFFIX}), '.', '') END AS file_type FROM documents_named",
    "file_catalog": with_views("catalog_files", "catalog_sidecars")
    + " SELECT file_name, size_bytes, uploaded_at FROM catalog_files"
    " LEFT JOIN catalog_sidecars ON file_name = name"
    r" WHERE regexp_extract(file_name, '\.[^.]*$') IN ('.xlsx', '.xls')"
    " ORDER BY uploaded_at DESC NULLS LAST, file_name",
    "read_metadata_json": with_views("supplier_sidecars")
    + r" SELECT regexp_replace(file_name, '\.meta\.json$', '') AS name,"
    " CASE WHEN whole THEN content ->> 'filename' END AS filename,"
    " CASE WHEN whole THEN CAST(content ->> 'size_bytes' AS double) END AS size_bytes,"
    " CASE WHEN whole THEN content ->> 'uploaded_at' END AS uploaded_at,"
    " CASE WHEN whole THEN content ->> 'file_type' END AS file_type,"
    " CASE WHEN NOT whole THEN content END AS corrupt"
    " FROM (SELECT *, json_valid(content) AS whole FROM supplier_sidecars)",
    "ingest_manifest": with_views("document_files")
    + " SELECT file_name AS filename, CAST(coalesce(strlen(content), 0) AS bigint)"
    " AS size_bytes, 'document' AS file_type, file_name FROM document_files",
    "parse_metadata": "SELECT event_id,"
    " CAST(json_extract(props, '$.k') AS bigint) AS k FROM events",
    "write_csv": f"SELECT {_CSV_COLUMNS} FROM conversations",
    "load_csv_with_breaks": "SELECT doc_id, '\"' || text || '\"' || chr(10) || lang AS quoted,"
    " n_chars FROM documents",
    "write_reports": _document_reports("doc_id", f"{_LEAD} AS lead"),
    "write_report_files": "SELECT report_name, content FROM ("
    + _document_reports("doc_id")
    + ")",
    "report_html": "SELECT doc_id, concat("
    f"{_quote(_HTML[0])}, {_ESCAPED}, {_quote(_HTML[1])}) AS html FROM documents",
    "write_summaries": f"{_NAMED} SELECT doc_id, file_name AS original_file,"
    f" text AS summary, {_LEAD} AS lead,"
    r" concat(regexp_replace(file_name, '\.[^.]+$', ''), '_summary.txt')"
    f" AS summary_file, CAST(length(text) AS integer) AS summary_length,"
    f" '{CREATED_AT}' AS created_at FROM documents_named",
    "filter_gt": "SELECT * FROM events WHERE value > 100",
    "coerce_mixed": f"{_LINEITEM_TEXT} SELECT * REPLACE"
    " (coalesce(t_mixed, 'nan') AS t_mixed) FROM lineitem_text",
    "select_roles": "SELECT p_partkey, p_size, p_retailprice FROM part",
    "infer_types": f"{_LINEITEM_TEXT} {_inferred()}",
    "mixed_columns": f"{_LINEITEM_TEXT} SELECT * FROM ({_inferred()})"
    " WHERE inferred_type = 'mixed'",
    "shape_metrics": f"{_EVENTS} {_SHAPE}",
    "missing_by_column": f"{_EVENTS} {_MISSING_BY_COLUMN}",
    "completeness": f"{_EVENTS} SELECT round(100.0 - missing_values"
    f" / (total_rows * total_columns) * 100.0, 4) AS completeness_pct FROM ({_SHAPE})",
    "schema_description": "SELECT (SELECT count(*) FROM customer) AS row_count,"
    " CAST(5 AS bigint) AS column_count,"
    " 'c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment' AS column_names,"
    " 'bigint, string, int, double, string' AS column_types,"
    " string_agg(concat('{\"c_custkey\":', c_custkey, ',\"c_name\":\"', c_name,"
    " '\",\"c_nationkey\":', c_nationkey, ',\"c_acctbal\":', c_acctbal,"
    " ',\"c_mktsegment\":\"', c_mktsegment, '\"}'), chr(10) ORDER BY c_custkey)"
    " AS sample_data"
    " FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)",
    "numeric_stats": _stats(
        "lineitem",
        [
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
        ],
    ),
    "numeric_stats_missing": _stats(
        "e",
        ["event_id", "user_id", "value", "nothing"],
        _EVENTS + ", e AS (SELECT *, CASE WHEN value < 0 THEN value END AS nothing"
        " FROM events_missing)",
    ),
    "profile_by_group": _stats(
        "lineitem",
        [
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
        ],
        by="l_returnflag",
    ),
    "profile_by_many_groups": _stats(
        "orders", ["o_totalprice"], by="o_custkey", mean_digits=6
    ),
    "profile_by_supplier": _WITH_TOTALS.format(
        "", _stats("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], by="l_suppkey", mean_digits=15)
    ),
    "profile_by_event_type": _WITH_TOTALS.format(
        _EVENTS, _stats("events_missing", ["event_id", "user_id", "value"], by="event_type", mean_digits=15)
    ),
    "head_n": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    "column_average": "SELECT round(avg(o_totalprice), 4) AS average FROM orders",
    "count_unique": "SELECT count(DISTINCT user_id) AS unique_count FROM events",
    "value_counts": f"{_EVENTS} SELECT event_type, count(*) AS count"
    " FROM events_missing WHERE event_type IS NOT NULL GROUP BY event_type"
    " ORDER BY count DESC, event_type",
    "frequent_values": "SELECT props, count(*) AS count FROM events GROUP BY props"
    " HAVING count(*) > 0.01 * (SELECT count(props) FROM events)"
    " ORDER BY count DESC, props",
    "summary_statistics": _summary(
        "events_missing", ["event_id", "user_id", "value"], _EVENTS
    ),
    "top_n": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "latest_by_key": "SELECT * FROM events QUALIFY row_number() OVER"
    " (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "upsert_by_key": "SELECT * FROM events QUALIFY row_number() OVER"
    " (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "last_accessed": "SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 1",
    "attach_responses": with_views("label_responses")
    + f" SELECT doc_id, lang, coalesce(response, {_quote(NO_INSIGHTS)}) AS response"
    " FROM documents LEFT JOIN label_responses USING (doc_id)",
    "text_metrics": "SELECT doc_id,"
    f" CAST(len(regexp_extract_all(text, '[^{_SPACE}]+')) AS integer) AS word_count,"
    " CAST(length(text) AS integer) AS char_count FROM documents",
    "text_preview": "SELECT doc_id, CASE WHEN length(text) > 1000"
    " THEN concat(substring(text, 1, 1000), '...') ELSE text END AS preview"
    " FROM documents",
    "truncate_input": "SELECT doc_id, substring(text, 1, 4000) AS text FROM documents",
    "summary_budget": f"{_NAMED} SELECT doc_id, length_label, {_BUDGET} AS max_words"
    " FROM documents_named",
    "summary_prompts": f"{_NAMED} SELECT doc_id, "
    + _fill(text.SUMMARY_PROMPT, words=_BUDGET, text="substring(text, 1, 4000)")
    + " AS prompt FROM documents_named",
    "insight_prompts": "SELECT doc_id, "
    + _fill(
        text.INSIGHT_PROMPT, type="'executive'", text="substring(text, 1, 1000)"
    )
    + " AS prompt FROM documents",
    "clean_response": with_views("conversation_responses")
    + " SELECT conv_id, turn, CASE WHEN contains(response, '```') THEN "
    + _strip(
        rf"regexp_replace(split_part(response, '```', 2), '\A[{_SPACE}]*python', '')"
    )
    + f" ELSE {_strip('response')} END AS response FROM conversation_responses",
    "chunk_text": "SELECT doc_id, CAST(o / 250 AS integer) AS chunk_no,"
    " substring(text, o + 1, 300) AS chunk FROM (SELECT doc_id, text,"
    " unnest(range(0, length(text), 250)) AS o FROM documents)",
    "lead_summary": f"{_NAMED} SELECT doc_id, {_BUDGET} AS max_words,"
    f" {_LEAD} AS summary FROM documents_named",
    "topk_similar": """
    WITH parts AS (SELECT label, unnest(embedding) AS x,
        generate_subscripts(embedding, 1) AS place FROM embeddings),
    means AS (SELECT label, list(x ORDER BY place) AS mean FROM
        (SELECT label, place, avg(CAST(x AS double)) AS x FROM parts
         GROUP BY label, place) GROUP BY label),
    scored AS (SELECT m.label AS query_id, vec_id, round(list_cosine_similarity(
        CAST(embedding AS double[]), mean), 12) AS exact FROM embeddings, means m)
    SELECT CAST(query_id AS bigint) AS query_id, vec_id, round(exact, 6) AS score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id)
        AS integer) AS rank
    FROM scored QUALIFY rank <= 3""",
    "topk_pruned": """
    WITH scored AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(
        CAST(c.embedding AS double[]), CAST(q.embedding AS double[])), 12) AS exact
        FROM embeddings q, embeddings c)
    SELECT query_id, vec_id, round(exact, 6) AS score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id)
        AS integer) AS rank
    FROM scored QUALIFY rank <= 3""",
    "report_document": _document_reports(
        "CAST(doc_id AS varchar) AS report_key", f"{_LEAD} AS lead"
    ),
}
ALL["report_whole_table"] = _data_report("executive", "'customers'")
ALL |= {f"report_{t}": _data_report(t) for t in reports.REPORT_TYPES}
