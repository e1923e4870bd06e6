"""DuckDB SQL of queries whose results SQL can express in steps."""

from __future__ import annotations

CRC_TABLE = "crc as (select list(c order by i) t from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) c from range(256) r(i)))"


def crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8, by the table t of CRC_TABLE."""
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::bigint, 2))::bigint)"
    return f"xor(list_reduce({code}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"


def _state(cost: str, audit: str, text: str) -> str:
    return f"{{'c': ({cost})::bigint, 'a': {audit}, 't': {text}}}"


def _edit(state: int, cost: str, letter: str, line: str = "''", allowed: str = "true") -> str:
    s = f"s[{state + 1}]"
    return _state(f"case when {allowed} then {s}.c + {cost} else 1000000000 end", f"{s}.a || '{letter}'", f"{s}.t || {line}")


def _conversations() -> str:
    """The cheapest edits forward from the first row: for each state the least cost, and of equals the least letters."""
    line = "chr(10) || role || ':' || text"
    user, assistant = "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
    keep = lambda q, role: _edit(q, "late", "K", line, f"not gone and role[1] = '{role}'")
    rerole = lambda q, as_line: _edit(q, "1 + late", "R", as_line, "not gone")
    drop = lambda q: _edit(q, "2", "D")
    after = [
        [drop(0)],
        [drop(1), keep(0, "s")],
        [drop(2), *(keep(q, "u") for q in (0, 1, 3)), *(rerole(q, user) for q in (0, 1, 3))],
        [drop(3), keep(2, "a"), rerole(2, assistant)],
    ]
    step = "[" + ", ".join(f"list_min([{', '.join(x)}])" for x in after) + "]"
    user_in, assistant_in = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    insert = f"[s[1], s[2], list_min([s[3], {', '.join(_edit(q, '5', 'I', user_in) for q in (0, 1, 3))}]), list_min([s[4], {_edit(2, '5', 'I', assistant_in)}])] s"
    never = _state("1000000000", "''", "''")
    start = f"[{_state('0', chr(39) * 2, chr(39) * 2)}, {never}, {never}, {never}] s"
    return f"""with recursive {CRC_TABLE}, d as (select conv_id, turn, coalesce(role, ' ') "role", coalesce(text, ' ') text, {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 k from conversations, crc),
    e as (select conv_id, turn, case when k = 4 then 'user' else role end "role", case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text, unnest(range(case k when 3 then 2 when 0 then 0 else 1 end)) copy from d),
    f as (select *, row_number() over w i, lag("role"[1]) over w prior, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) stop from e window w as (partition by conv_id order by turn nulls first, "role", text, copy)),
    b as (select *, i > min(i) over (partition by conv_id, "role", text) dup from f),
    g as (select *, stop = '' blank, stop <> '' and dup again, stop <> '' and not dup and stop not in ('.', '!', '?') short from b),
    h as (select *, blank or again gone, case when short then 5 else 0 end late from g),
    n as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count_if(blank) blank, count_if(again) duplicate, count_if(short) truncated, count_if(i > 1 and prior || "role"[1] not in ('su', 'ua', 'au')) illegal from h group by 1),
    c as (select distinct conv_id from conversations),
    r as (select conv_id, 0::bigint i, {insert} from (select conv_id, {insert} from (select conv_id, {start} from c)) union all
      select conv_id, i, {insert} from (select conv_id, i, {insert} from (select h.conv_id, h.i, {step} s from r join h on h.conv_id is not distinct from r.conv_id and h.i = r.i + 1))),
    z as (select c.conv_id, coalesce(n, 0) n, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal from c left join n on n.conv_id is not distinct from c.conv_id)
    select z.conv_id, gaps::bigint gaps, blank::bigint blank, duplicate::bigint duplicate, truncated::bigint truncated, illegal::bigint illegal, m.c "cost", m.a audit, sha256(substr(m.t, 2)) repaired_sha256
    from (select *, list_min([s[1], s[4]]) m from r) q join z on z.conv_id is not distinct from q.conv_id and z.n = q.i"""


OP11_SQL = _conversations()

OP13_SQL = f"""with recursive {CRC_TABLE}, u as (select coalesce(doc_id::varchar, '') id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) run from documents),
    h as (select run, {crc32("id || ':' || run")} h from u, crc where length(run) >= 7),
    w as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end word from h),
    c as (select word, count(*) n from w where length(word) >= 7 group by 1 having count(*) >= 2),
    x as (select word, i, substr(word, 1, i) || substr(word, i + 2) cut from (select word, unnest(range(length(word))) i from c)),
    p as (select a.word a, b.word b from x a join x b on a.cut = b.cut and a.i = b.i and a.word <> b.word union select x.word, c.word from x join c on x.cut = c.word union select c.word, x.word from x join c on x.cut = c.word),
    m as (select a word, count(*) n_near, arg_min({{'f': b, 'n': n}}, {{'k': -n, 'b': b}}) best from p join c on c.word = p.b group by 1),
    f as (select c.word, n, coalesce(n_near, 0) n_near, case when best.n >= 10 * n then best.f end form, case when best.n >= 10 * n then best.n end form_n from c left join m using (word)),
    t as (select word, word last, 0 k from f union all select t.word, f.form, k + 1 from t join f on f.word = t.last where f.form is not null),
    r as (select word, arg_max(last, k) root from t group by 1)
    select f.word, form, root, n, n_near, form_n from f join r on r.word = f.word"""
