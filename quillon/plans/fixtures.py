"""Small literal tables for operators whose domain the driver's tables don't hold.

Each table is given once, as SQL that Spark and DuckDB both read.
"""

from __future__ import annotations


def values(columns: str, *rows: str) -> str:
    """SELECT of literal rows; columns is a list of names and SQL types."""
    names = [c.strip().split(" ", 1) for c in columns.split(",")]
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in names)
    return f"SELECT {casts} FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({', '.join(n for n, _ in names)})"


HITS = values(
    "doc_id BIGINT, tier INT, doc_rank DOUBLE, best_rank DOUBLE, match_count BIGINT, colocated BOOLEAN, document_date DATE",
    "1, 0, 0.5, 0.5, 4, true, '2020-01-01'",
    "2, 0, 0.6, 0.3, 1, false, '2021-01-01'",
    "3, 0, 0.6, 0.3, 9, false, NULL",
    "4, 1, 0.9, 0.9, 9, true, '2022-01-01'",
    "5, 0, 0.25, 0.75, 2, true, '2019-01-01'",
    "6, 2, 0.0, 0.1, 1, false, '2023-01-01'",
    "7, 0, 0.25, 0.75, 2, true, '2019-01-01'",
)

NUMBERS = values("number VARCHAR(40)", "'055/2001'", "'243 /2002'", "'e-0012/2020'", "'E-12/2020'", "'700/2017'", "'  '", "NULL", "'F-09/2019'", "'2019-155'", "'000/2001'")

ANCHORS = values(
    "layer VARCHAR(20), para_from INT, para_to INT, section_path VARCHAR(40), ordinal INT, page_from INT, page_to INT",
    "'summary', 1, 2, 'X', 0, 3, 4",
    "'body', 3, 3, 'X', 1, 5, 5",
    "'body', 3, 7, NULL, 2, NULL, NULL",
    "'body', NULL, NULL, 'IV. Niðurstaða', 3, 12, NULL",
    "'body', NULL, NULL, 'IV. Niðurstaða', 4, 12, 14",
    "'body', NULL, NULL, 'IV. Niðurstaða', 5, NULL, NULL",
    "'lower_body', NULL, NULL, NULL, 6, NULL, NULL",
    "'lower_body', NULL, NULL, '', 7, NULL, NULL",
)

RULINGS = values(
    "doc_id VARCHAR(10), court VARCHAR(20), case_number VARCHAR(20), document_date DATE, verdict_type VARCHAR(20)",
    "'a', 'Hrd.', '055/2001', '2001-06-01', 'Dómur'",
    "'b', 'Hrd.', '700/2017', '2017-11-08', 'Dómur'",
    "'c', 'Hrd.', '700/2017', '2017-12-01', 'Úrskurður'",
    "'d', 'Hérd. Rvk.', 'E-12/2020', '2020-05-01', 'Dómur'",
    "'e', 'Hérd. Reykn.', 'E-12/2020', '2020-06-01', 'Dómur'",
    "'f', 'Féld.', 'F-9/2019', '2019-10-10', 'Dómur'",
    "'g', 'Féld.', '13/2001', '2001-12-12', 'Dómur'",
    "'h', 'Hrd. málsk.', '2019-155', '2019-08-01', 'Ákvörðun'",
    "'i', NULL, '1/2020', '2020-01-01', 'Dómur'",
    "'j', 'Lrd.', '5/2021', NULL, 'Dómur'",
)

REFERENCES = values(
    "from_doc_id VARCHAR(10), layer VARCHAR(20), char_start INT, target_court VARCHAR(20), target_case_number VARCHAR(20), target_date DATE, target_verdict VARCHAR(20), form VARCHAR(10)",
    "'q', 'body', 1, 'Hrd.', '55/2001', NULL, NULL, 'prose'",
    "'q', 'body', 2, 'Hrd.', '700/2017', '2017-11-08', NULL, 'prose'",
    "'q', 'body', 3, 'Hrd.', '700/2017', NULL, 'Úrskurður', 'prose'",
    "'q', 'body', 4, 'Hrd.', '700/2017', NULL, NULL, 'prose'",
    "'q', 'body', 5, 'Hrd.', '700/2017', '2017-11-09', NULL, 'prose'",
    "'q', 'body', 6, 'Hérd.', 'E-12/2020', NULL, NULL, 'prose'",
    "'q', 'body', 7, 'Hérd. Rvk.', 'E-12/2020', NULL, NULL, 'prose'",
    "'q', 'body', 8, 'Féld.', '9/2019', NULL, NULL, 'prose'",
    "'q', 'body', 9, 'Féld.', '13/2001', NULL, NULL, 'prose'",
    "'q', 'body', 10, 'Hrd.', '12/1985', NULL, NULL, 'prose'",
    "'q', 'body', 11, 'Hrd.', NULL, NULL, NULL, 'reporter'",
    "'b', 'body', 12, 'Hrd.', '700/2017', '2017-11-08', NULL, 'prose'",
    "'old', 'body', 13, 'Hrd.', '700/2017', NULL, NULL, 'prose'",
    "'q', 'lower_body', 14, 'Lrd.', '5/2021', NULL, NULL, 'abbrev'",
    "'q', 'summary', 15, 'Hrd.', '700/2017', '2017-11-08', NULL, 'prose'",
)

CITING = values("doc_id VARCHAR(10), document_date DATE", "'q', '2022-01-01'", "'b', '2017-11-08'", "'old', '2010-01-01'")

DOCUMENT_ROWS = values(
    "doc_id VARCHAR(10), case_number VARCHAR(20), document_date DATE, court VARCHAR(20), verdict_type VARCHAR(20), body_text VARCHAR(300), n_plaintiffs INT, n_defendants INT, n_keywords INT",
    "'a', '55/2001', '2001-06-01', 'Hrd.', 'Dómur', 'x', 1, 1, 2",
    "'b', NULL, NULL, NULL, NULL, NULL, 0, 0, 0",
    "'c', '55/2010', '2001-06-01', 'Lrd.', 'Annað', '', 0, 2, 1",
    "'d', '2010/55', '2017-06-01', 'Hrd. x', 'Dómur', 'short', 3, 0, NULL",
    "'e', '55/2020', '1850-06-01', 'Hrd.', 'Úrskurður', NULL, NULL, NULL, 1",
)

PROVISION_ROWS = values(
    "doc_id VARCHAR(10), law VARCHAR(10), gr INT, mgr INT, sfx VARCHAR(2)",
    "'a', '19/1940', 218, 2, NULL",
    "'a', '91/1991', 130, NULL, NULL",
    "'b', '19/1940', 218, NULL, 'a'",
    "'b', '33/1944', 70, 1, NULL",
    "'c', '19/1940', 70, 2, NULL",
)

LINK_ROWS = values(
    "from_doc_id VARCHAR(10), to_doc_id VARCHAR(10), relation VARCHAR(20), confidence DOUBLE, method VARCHAR(20)",
    "'h1', 'l1', 'appealed_from', 0.9, 'casenum'",
    "'l1', 'h1', 'appealed_to', 0.8, 'casenum'",
    "'l1', 'h1', 'appealed_to', 0.95, 'court_date'",
    "'l1', 's1', 'appealed_to', 0.9, 'casenum'",
    "'h1', 'l1', 'appealed_to', 0.9, 'casenum'",
    "'s1', 'l1', 'appealed_from', 0.9, 'casenum'",
    "'s1', 'x9', 'cites', 1.0, 'citation'",
    "'p1', 'l1', 'leyfisbeidni_um', 1.0, 'casenum'",
)

ARTICLE_ROWS = values(
    "issue_id INT, article_id INT, page_start INT, page_end INT, title_ok BOOLEAN, author_ok BOOLEAN, page_ok BOOLEAN, record_ok BOOLEAN",
    "1, 1, 1, 9, true, true, true, true",
    "1, 2, 12, 20, true, true, true, true",
    "2, 3, 1, 9, true, true, false, true",
    "2, 4, 10, 20, true, true, true, true",
    "3, 5, 1, 9, true, true, true, true",
    "3, 6, 17, 20, true, true, true, true",
    "4, 7, 1, 2, true, NULL, true, false",
)

MERGES = values(
    "id INT, old_json VARCHAR(60), new_json VARCHAR(60)",
    "1, '{\"a\":\"1\",\"b\":\"2\"}', '{\"b\":\"3\"}'",
    "2, NULL, '{\"a\":\"1\"}'",
    "3, '{\"a\":\"1\"}', NULL",
    "4, '{\"a\":1,\"b\":true}', '{\"a\":2.5,\"c\":{\"d\":[1,2]}}'",
    "5, '{\"a\":{\"x\":1},\"b\":\"t\"}', '{\"b\":false}'",
)
