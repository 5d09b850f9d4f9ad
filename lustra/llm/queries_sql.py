"""SQL counterparts of the queries, where SQL can express them."""

from __future__ import annotations


def _any_case(word: str) -> str:
    """A pattern for ASCII letters in either case; the flag would also take other letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text: byte by byte and bit by bit."""
    bits = "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda crc, byte: {bits}), 4294967295::bigint)"


def _merkle() -> str:
    def field(c: str) -> str:
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""rows as (
            select doc_id, dense_rank() over (order by lang nulls first) - 1 as tree, {digest("text")} as leaf,
                   case when {_crc32("doc_id::varchar")} % 3 = 0 then {digest(lowered)} end as tampered
            from documents)""",
        """g0 as (
            select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos,
                   leaf as h, count(*) over (partition by tree) as n
            from rows)""",
    ]

    def levels(name: str, count: int) -> None:
        """The runs of each level, as lists, and the level above."""
        for k in range(count):
            parts.append(
                f"""{name}runs{k} as (
                    select tree, pos // 8 as run, list(h order by pos) as hs, any_value(n) as n
                    from {name}{k} where n > 1 group by tree, pos // 8)"""
            )
            parts.append(
                f"""{name}{k + 1} as (
                    select tree, run as pos, sha256(array_to_string(hs, '')) as h, (n + 7) // 8 as n from {name}runs{k}
                    union all select tree, pos, h, n from {name}{k} where n = 1)"""
            )

    def fold(name: str, trees: str, count: int) -> None:
        for k in range(count):
            left, right = "array_to_string(hs[:p.pos % 8], '')", "array_to_string(hs[p.pos % 8 + 2:], '')"
            parts.append(
                f"""{name}{k + 1} as (
                    select p.* replace (
                        p.pos // 8 as pos,
                        case when r.run is null then node else sha256({left} || node || {right}) end as node,
                        case when r.run is null then siblings else siblings || {left} || {right} end as siblings)
                    from {name}{k} p left join {trees}runs{k} r on r.tree = p.tree and r.run = p.pos // 8)"""
            )

    levels("g", 8)
    parts.append("t0 as (select 0 as tree, tree as pos, h, (select count(distinct tree) from rows) as n from g8)")
    levels("t", 3)
    parts.append("p0 as (select doc_id, tree, pos, leaf, coalesce(tampered, leaf) as node, '' as siblings from g0)")
    fold("p", "g", 8)
    parts.append("q0 as (select p8.* replace (0 as tree, tree as pos), g8.h as subroot from p8 join g8 using (tree))")
    fold("q", "t", 3)
    return (
        "with "
        + ",\n".join(parts)
        + """
        select doc_id, leaf, subroot, t3.h as root, sha256(siblings) as proof_sha256, node as folded_root, node = t3.h as verified
        from q3, t3"""
    )


def _secrets() -> str:
    words = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
    assign = rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    rules = [
        # kind, pattern, group, least length
        ("assign", assign, 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
        ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
        ("github", "gh[opsur]_[A-Za-z0-9]{36,}", 0, 0),
        ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
        ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
        ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ]
    found = " union all ".join(
        f"""select nr, '{kind}' as kind, {i} as number, {least} as least,
                   list_transform(string_split_regex(body, '{pattern}'), lambda x: length(x)) as gaps,
                   list_transform(regexp_extract_all(body, '{pattern}', 0), lambda x: length(x)) as lengths,
                   list_transform(regexp_extract_all(body, '{pattern}', {group}), lambda x: length(x)) as sizes
            from texts where regexp_matches(body, '{pattern}')"""
        for i, (kind, pattern, group, least) in enumerate(rules)
    )
    return f"""
        with texts as (select row_number() over () as nr, doc_id, coalesce(text, '') as body from documents),
        found as ({found}),
        each as (select *, unnest(range(1, len(lengths) + 1)) as i from found),
        spans as (
            select nr, kind, number,
                   (list_sum(gaps[:i]) + coalesce(list_sum(lengths[:i - 1]), 0))::bigint as first,
                   first + lengths[i] as last
            from each where sizes[i] >= least),
        listed as (
            select nr, string_agg(kind || ':' || first || ':' || last, ',' order by first, number) as spans,
                   string_agg(kind || ':' || first || ':' || last, ',' order by first, number) filter (number < 3) as base,
                   count(*) filter (number = 0) as n_assign, count(*) filter (number = 1) as n_access,
                   count(*) filter (number = 2) as n_hex
            from spans group by nr)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from texts left join listed using (nr)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: The rules of the url query: host, start of the path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _url_verdicts() -> str:
    rules = ", ".join(f"('{host}', '{start}', '{verdict}')" for host, start, verdict in URL_RULES)
    return f"""
        with rests as (
            select row_number() over () as nr, page_id,
                   case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
            from pages),
        parts as (
            select nr, page_id, regexp_extract(rest, '^[^/?#]*') as raw,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
            from rests),
        hosts as (select nr, page_id, translate(raw, '{UPPER}', '{LOWER}') as host, path from parts),
        fits as (
            select nr, max_by(r.host || r.start, length(r.host || r.start)) as rule,
                   max_by(r.verdict, length(r.host || r.start)) as verdict
            from hosts h join (values {rules}) r(host, start, verdict)
              on (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.start)
            group by nr)
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from hosts left join fits using (nr)"""


def _words(table: str, key: str, pattern: str, lower: bool) -> str:
    """The words of all texts with their places, from 0."""
    text = f"translate(text, '{UPPER}', '{LOWER}')" if lower else "text"
    return f"""
        select {key}, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as j, len(ws) as n
        from (select {key}, regexp_extract_all(coalesce({text}, ''), '{pattern}') as ws from {table})"""


def _windows(words: str, key: str, width: str) -> str:
    """Every run of so many consecutive words as one text."""
    return f"""
        select * from (
            select {key}, j, n, array_to_string(list(word) over (
                partition by {key} order by j rows between current row and {width} - 1 following), ' ') as body
            from {words}) where j + {width} <= n"""


def _window_repeats() -> str:
    return f"""
        with words as ({_words("documents", "doc_id", WORD, False)}),
        windows as ({_windows("words", "doc_id", "13")}),
        firsts as (select body, min(doc_id) as first from windows group by body),
        covered as (
            select distinct doc_id, unnest(range(j, j + 13)) as j
            from windows join firsts using (body) where first < doc_id),
        kept as (
            select doc_id, string_agg(word, ' ' order by j) as body, count(*) as n_kept
            from words anti join covered using (doc_id, j) group by doc_id),
        sizes as (select doc_id, any_value(n) as n from words group by doc_id)
        select doc_id, coalesce(n, 0)::bigint as n_words, (coalesce(n, 0) - coalesce(n_kept, 0))::bigint as n_removed,
               sha256(coalesce(body, '')) as kept_sha256
        from documents left join sizes using (doc_id) left join kept using (doc_id)"""


def _benchmark_leaks() -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lengths = range(1, 11)
    items = " union all ".join(
        f"select item_id, body, {k} as width from ({_windows('item_words', 'item_id', str(k))}) where {'true' if k == 10 else f'n = {k}'}"
        for k in lengths
    )
    docs = " union all ".join(f"select doc_id, j, body, {k} as width from ({_windows('words', 'doc_id', str(k))})" for k in lengths)
    return f"""
        with words as ({_words("documents", "doc_id", pattern, True)}),
        item_words as ({_words("benchmark", "item_id", pattern, True)}),
        items as (select distinct * from ({items})),
        found as (select doc_id, j, width, item_id from ({docs}) join items using (body, width)),
        hits as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(j, j + width)) as place from found) group by doc_id),
        listed as (
            select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
            from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id),
        sizes as (select doc_id, any_value(n) as n from words group by doc_id)
        select doc_id, coalesce(n, 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
        from documents left join sizes using (doc_id) left join hits using (doc_id) left join listed using (doc_id)"""


def _jaccard_groups() -> str:
    return f"""
        with recursive words as ({_words("documents", "doc_id", WORD, True)}),
        shingles as (
            select distinct doc_id, body from ({_windows("words", "doc_id", "5")})
            union
            select doc_id, string_agg(word, ' ' order by j) from words where n < 5 group by doc_id),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        common as (
            select a.doc_id as u, b.doc_id as v, count(*) as shared
            from shingles a join shingles b on a.body = b.body and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
        links as (
            select u, v from common join sizes a on a.doc_id = u join sizes b on b.doc_id = v
            where 100 * shared >= 75 * (a.n + b.n - shared)),
        reach as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
        firsts as (select u as doc_id, min(v) as first from reach group by u)
        select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(least(first, doc_id), doc_id) as component_id
        from documents left join sizes using (doc_id) left join firsts using (doc_id)"""


SQL: dict[str, str] = {
    "op3_url_verdicts": _url_verdicts(),
    "op4_window_repeats": _window_repeats(),
    "op5_benchmark_leaks": _benchmark_leaks(),
    "op8_jaccard_groups": _jaccard_groups(),
    "op11_merkle_proofs": _merkle(),
    "op13_secret_spans": _secrets(),
}
