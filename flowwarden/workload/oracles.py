"""The same answers in SQL, written separately from the operators: nested-loop joins, plain windows."""

from __future__ import annotations

from ..schema import KEY, WIDTH
from .views import RULE_ROWS

DAY = 86_400_000_000
HOUR = 3_600_000_000
DAY0 = 19723

K5 = "srcip, dstip, sport, dport, proto"
FLOW = f"host, {K5}"
GROUP = ", ".join(f"k_{c}" for c in KEY)

PACKETS = """
packets as (
  select event_id as pkt_no, epoch_us(ts) as us, user_id % 4 as host,
    case when event_id % 2 = 0 then 167772160 + user_id else 167837696 + user_id % 8 end as srcip,
    case when event_id % 2 = 0 then 167837696 + user_id % 8 else 167772160 + user_id end as dstip,
    case when event_id % 2 = 0 then 50000 + user_id % 3 else 2500 end as sport,
    case when event_id % 2 = 0 then 2500 else 50000 + user_id % 3 end as dport,
    cast(case when event_type in ('click', 'view', 'error') then 6 else 17 end as bigint) as proto,
    64 + cast(floor(value * 3) as bigint) as len,
    case when event_id % 7 = 0 then greatest(event_id - back, 0) else event_id end * 1460 as seq,
    (event_id // back) * back * 1460 as ack
  from events, (select count(*) // 5 as back from events)
)"""


def _mask(length: int, bits: int) -> int:
    return ((1 << length) - 1) << (bits - length)


def _rules() -> str:
    rows = []
    for r in RULE_ROWS:
        cells = [r[0]]
        filters, masks, groups = [], [], []
        for i, c in enumerate(KEY):
            value, length = r[i + 1]
            grouping = max(length, r[6][i])
            filters.append(value & _mask(length, WIDTH[c]))
            masks.append(_mask(length, WIDTH[c]))
            groups.append(_mask(grouping, WIDTH[c]))
        cells += filters + masks + groups
        body = ", ".join(f"cast({x} as bigint)" for x in cells)
        vf = DAY0 + 2 * r[0]
        rows.append(f"({body}, '{r[7]}', cast({r[8]} as bigint), cast({r[9]} as bigint), {vf}, {vf + 10})")
    names = ["rule_id", *[f"f_{c}" for c in KEY], *[f"m_{c}" for c in KEY], *[f"g_{c}" for c in KEY]]
    return (
        f"rules({', '.join(names)}, agg, threshold, n_days, vf, vt) as (values\n  " + ",\n  ".join(rows) + ")"
    )


RULES = _rules()
HOSTS = "hosts(host, join_epoch) as (values (0, 0), (1, 3), (2, 6), (3, 9))"


def match_on(flow: str = "p", rule: str = "r") -> str:
    return " and ".join(f"({flow}.{c} & {rule}.m_{c}) = {rule}.f_{c}" for c in KEY)


def grouped(flow: str = "p", rule: str = "r") -> str:
    return ", ".join(f"{flow}.{c} & {rule}.g_{c} as k_{c}" for c in KEY)


def flow_days(epoch: int = DAY) -> str:
    return f"""
fd as (select {FLOW}, us // {epoch} as epoch, count(*) as n, cast(sum(len) as bigint) as bytes
  from packets group by all)"""


def sessions(epoch: int) -> str:
    return f"""
fe as (select distinct {FLOW}, us // {epoch} as epoch from packets),
lagged as (select *, lag(epoch) over (partition by {FLOW} order by epoch) as pe from fe),
ses as (select {FLOW}, epoch, max(case when pe is null or epoch - pe > 1 then epoch end)
    over (partition by {FLOW} order by epoch) as session from lagged),
ps as (select p.*, s.epoch, s.session from packets p join ses s
    on {" and ".join(f"p.{c} = s.{c}" for c in ["host", *KEY])} and p.us // {epoch} = s.epoch)"""


SES = f"{FLOW}, session"

LOST = f"""
lost as (select *, seq <= greatest(coalesce(max(seq) over (partition by {SES} order by us, pkt_no
    rows between unbounded preceding and 1 preceding), 0), 0) as lost from ps)"""


def with_(*ctes: str) -> str:
    return "with " + ",".join(ctes) + "\n"


STATE = f"""
acks as (select *, coalesce(lag(ack) over (partition by {SES} order by us, pkt_no), 0) as pa from ps),
steps as (select *, case when ack = pa then 1460
    else -(((ack - pa) % 4294967296 + 4294967296) % 4294967296) end as step from acks),
sums as (select *, sum(step) over (partition by {SES} order by us, pkt_no) as s from steps),
dups as (select *, cast(s - least(0, min(s) over (partition by {SES} order by us, pkt_no)) as bigint) as dup
    from sums),
ends as (select {SES}, epoch, max(seq) as mx, last(ack order by us, pkt_no) as ack_v1,
    last(dup order by us, pkt_no) as dup_v1 from dups group by all),
state as (select {SES}, epoch, ack_v1, dup_v1,
    coalesce(lag(ack_v1) over w, 0) as ack_v2,
    greatest(0, max(mx) over (partition by {SES} order by epoch)) as seq_v1,
    greatest(0, coalesce(max(mx) over (partition by {SES} order by epoch
      rows between unbounded preceding and 1 preceding), 0)) as seq_v2
  from ends window w as (partition by {SES} order by epoch))"""

REVERSED = (
    "a.host = b.host and a.epoch = b.epoch and a.srcip = b.dstip and a.dstip = b.srcip "
    "and a.sport = b.dport and a.dport = b.sport and a.proto = b.proto"
)

CONGESTED = f"""
unack as (select a.host, {", ".join(f"a.{c}" for c in KEY)}, a.epoch,
    case when a.seq_v2 - b.ack_v2 <= 0 or b.ack_v1 - b.ack_v2 + b.dup_v1 > a.seq_v2 - b.ack_v2 then 0
      else 100 - cast(trunc(100 * (b.ack_v1 - b.ack_v2 + b.dup_v1) / (a.seq_v2 - b.ack_v2)) as bigint) end as unacked
  from state a join state b on {REVERSED})"""


def congestion_values(where: str, win: str) -> str:
    return f"""
cong as (select r.rule_id, p.host, {win} as win, {grouped()}, max(p.unacked) as value
  from unack p join rules r on {match_on()} where {where} group by all)"""


CONG = congestion_values("r.agg = 'congestion'", "p.epoch // r.n_days")
CONGESTION = with_(PACKETS, RULES, sessions(DAY), STATE, CONGESTED, CONG)


def bursts(gap: int) -> str:
    return f"""
marks as (select *, lag(us) over (partition by {FLOW} order by us, pkt_no) as pu from packets),
runs as (select *, max(case when pu is null or us - pu >= {gap} then us end)
    over (partition by {FLOW} order by us, pkt_no) as burst from marks),
bursts as (select {FLOW}, burst, min(seq) as seq1, max(seq) as seq2, count(*) as n, min(us) as t0, max(us) as t1
  from runs group by all having count(*) > 4)"""


IN_BURST = f"""
hits as (select l.*, exists (select 1 from bursts b where {" and ".join(f"b.{c} = l.{c}" for c in ["host", *KEY])}
    and l.seq between b.seq1 and b.seq2) as hit from lost l where l.lost)"""


def values_cte(where: str = "true", win: str = "epoch // r.n_days", live: str = "true", in_bursts: str = "") -> str:
    """Values of all rules; needs `lost`. `in_bursts` says which lost numbers lie in a burst, by default in any of their flow."""

    def part(source: str, x: str, kinds: str, more: str = "true") -> str:
        return f"""
    select r.rule_id, r.agg, p.host, {win} as win, {grouped()}, {x} as x
    from {source} p join rules r on {match_on()} where r.agg in ({kinds}) and {where} and {live} and {more}"""

    counted = part("lost", "case r.agg when 'packet' then 1 when 'volume' then p.len else cast(p.lost as bigint) end", "'packet', 'volume', 'loss'")
    congested, burst_lost = part("unack", "p.unacked", "'congestion'"), part("hits", "1", "'burstloss'", "p.hit")
    return ",".join(
        [
            STATE,
            CONGESTED,
            in_bursts or ",".join([bursts(2 * DAY), IN_BURST]),
            f"""
vals as (
  select rule_id, host, win, {GROUP}, cast(case when agg = 'congestion' then max(x) else sum(x) end as bigint) as value
  from ({counted} union all {congested} union all {burst_lost}) group by rule_id, agg, host, win, {GROUP})""",
        ]
    )


VALS = with_(PACKETS, RULES, sessions(DAY), LOST, values_cte())
VALUE = f"rule_id, host, win, {GROUP}, value"

def seen(exact: bool) -> str:
    cell = "seq" if exact else "(xor(seq & 4294967295, (seq & 4294967295) >> 16)) & 1048575"
    return with_(
        PACKETS,
        f"""
numbered as (select *, row_number() over (partition by host order by us, pkt_no) - 1 as n, {cell} as cell from packets),
gens as (select *, n // 500 as gen, lag(n // 500) over (partition by host, cell order by n) as pg from numbered)""",
    ) + "select pkt_no, coalesce(pg >= gen - 1, false) as seen from gens"


def admitted(by: str = FLOW, needed: int = 9, epoch: int = 3 * DAY) -> str:
    return with_(
        PACKETS,
        sessions(epoch),
        f"""
adm as (select pkt_no, epoch, coalesce(sum((len + 63) // 64) over (partition by {SES} order by us, pkt_no
    rows between unbounded preceding and 1 preceding), 0) >= {needed} as admitted from ps)""",
    )


def gather(mode: str, extra: str = "true") -> str:
    whole = "having count(*) = 4 and" if mode == "strict" else "having"
    return with_(
        PACKETS,
        RULES,
        HOSTS,
        sessions(DAY),
        LOST,
        values_cte(),
        f"""
keys as (select v.rule_id, win, {GROUP}, sum(value) as total from vals v join rules r using (rule_id)
  group by v.rule_id, win, {GROUP}, threshold {whole} max(value) >= threshold // 4),
filled as (select k.rule_id, k.win, {", ".join(f"k.k_{c}" for c in KEY)}, cast(h.host as bigint) as host, k.total,
    coalesce(v.value, 0) as value
  from keys k cross join hosts h left join vals v on v.rule_id = k.rule_id and v.win = k.win and v.host = h.host
    and {" and ".join(f"v.k_{c} = k.k_{c}" for c in KEY)}),
checked as (select *, min(case when host < 2 then value end) over (partition by rule_id, win, {GROUP}) as least_two
  from filled),
kept as (select c.* from checked c join rules r using (rule_id) where {extra})""",
    )


GATHERED = f"rule_id, win, {GROUP}, host, value"

IP_TEXT = "((x >> 24) & 255) || '.' || ((x >> 16) & 255) || '.' || ((x >> 8) & 255) || '.' || (x & 255)"


def ip_text(expr: str) -> str:
    return "(" + " || '.' || ".join(f"(({expr}) >> {s} & 255)" for s in (24, 16, 8, 0)) + ")"


def sql_mask(length: str, bits: int) -> str:
    full = (1 << bits) - 1
    return f"((({full}::hugeint << ({bits} - least({length}, {bits}))::int) & {full}::hugeint)::bigint)"


# What each generated line must parse to, straight from the customer key.
CUSTOMER_RULES = f"""
raw as (select c_custkey as k, c_custkey % 19 <> 0 and not (c_custkey % 23 = 0 and c_custkey % 3 <> 0)
    and c_custkey % 29 <> 0 and (c_custkey % 9) % 2 = 0 as good from customer),
crules as (select k as rule_id, not good as _corrupt,
  case when good then (167772160 + k) & {sql_mask('k % 40', 32)} end as srcip,
  case when good then (167837696 + k * 7) & {sql_mask('k % 33', 32)} end as dstip,
  case when good then (k % 65536) & {sql_mask('k % 18', 16)} end as sport,
  case when good then 2500 end as dport,
  case when good then case when k % 2 = 0 then 6 else 17 end end as proto,
  case when good then least(k % 40, 32) end as len_srcip,
  case when good then k % 33 end as len_dstip,
  case when good then least(k % 18, 16) end as len_sport,
  case when good then 16 end as len_dport,
  case when good then 8 end as len_proto,
  case when good then case when k % 5 = 0 then 0 else least(k % 35, 32) end end as fg_srcip,
  case when good then case when k % 5 = 0 then 0 else 24 end end as fg_dstip,
  case when good then case when k % 5 = 0 then 0 else 0 end end as fg_sport,
  case when good then case when k % 5 = 0 then 0 else 16 end end as fg_dport,
  case when good then case when k % 5 = 0 then 0 else 8 end end as fg_proto,
  case when good then case when k % 3 = 0 then 'volume' else 'packet' end end as agg,
  case when good then k * 10 end as threshold,
  case when good then k % 9 * 5 + 10 end as interval_ms
  from raw)"""

# The controller log as a table, straight from the events.
LOG = """
clog as (
  select * from (
    select 1000000000 + event_id * 2600000 + cast(floor(value * 1000) as bigint) as time,
      cast(case when s in (7, 8) then 0 else event_id % 4 end as int) as server,
      cast(case when s in (0, 2, 3) then 2 when s = 4 then case when g % 6 = 0 then 4 else 2 end
        when s in (1, 5) then 1 when s = 6 then 3 when s = 7 then 5
        when s = 8 then case when g % 2 = 0 then 6 else 7 end
        when g % 3 = 1 then 8 end as int) as type,
      case when s in (7, 8) then 0 else g end as server_epoch, cast(g % 5 as int) as event, g as epoch
    from (select *, event_id % 10 as s, event_id // 10 as g from events))
  where type is not null),
lat as (select event, epoch, min(case when type = 1 then time end) - min(case when type = 2 then time end) as first_ask,
    max(case when type = 1 then time end) - min(case when type = 2 then time end) as last_ask,
    max(case when type = 2 then time end) - min(case when type = 2 then time end) as last_sat,
    max(case when type = 3 then time end) - min(case when type = 2 then time end) as last_return
  from clog group by event, epoch
  having count(*) filter (type = 2) = 4 and count(*) filter (type = 1) > 0 and count(*) filter (type = 5) > 0
    and count(*) filter (type = 3) > 0)"""

TRACE = """
trace as (select epoch_us(ts) - 1704067200000000 as us,
    cast((epoch_us(ts) - 1704067200000000) // 1000000 || '.' ||
      lpad(cast((epoch_us(ts) - 1704067200000000) % 1000000 as varchar), 6, '0') as double) as t,
    cast(user_id % 4 as int) as src, cast(64 + floor(value * 3) as int) as len,
    cast(case when event_type in ('click', 'view', 'error') then 6 else 17 end as int) as proto
  from events where user_id % 10 <> 9),
kept as (select * from trace where src <> 3),
bounds as (select min(us) as lo, max(us) as hi from kept),
series as (
  select b.bin, l.src, l.proto, cast(coalesce(sum(k.len), 0) as bigint) as bytes
  from (select unnest(range((hi - lo) // 3600000000 + 21)) as bin from bounds) b
  cross join (select distinct src, proto from kept) l
  left join (select k.*, (us - lo) // 3600000000 as bin from kept k, bounds) k
    on k.bin = b.bin and k.src = l.src and k.proto = l.proto
  group by all)"""

RUNS = """
runs as (select o_orderkey as k, cast(round(o_totalprice * 100) as bigint) as cents,
    ['20', '10', '5', '1'][o_orderkey % 4 + 1] as interval, cast(150 * (o_orderkey % 3 + 1) as varchar) as flows,
    cast(4 * (o_orderkey % 2 + 1) as varchar) as rules_per_flow,
    cast(5000000 + 500000 * (o_orderkey % 20) as varchar) as offered, cast(o_custkey % 10 as varchar) as run
  from orders)"""

DOS = """
dos as (select cast(8 << cast(o_custkey % 4 as int) as int) as patterns, (o_orderkey % 97) / 100.0::double as dos_share,
    o_orderkey % 61 + 1 as dos_len, o_orderkey % 10 as ran, o_custkey * 7 % 300 as loss, o_custkey % 5 as unfinished
  from orders),
measured as (select patterns, dos_share, min(dos_len) as threshold from dos
  where ran > 0 and loss < 100000 and unfinished < 2 group by all)"""

PREDICTED = """
params as (select cast(8 << cast(p_partkey % 4 as int) as int) as patterns,
    cast(607 + p_partkey % 4 * 300 as int) as match_cycles, (p_partkey % 97) / 100.0::double as d,
    1.0e9 + p_retailprice * 100000 as budget from part),
rated as (select *, 1e10 / ((64 * d + 1500 * (1 - d) + 20) * 8) as rate from params),
predicted as (select patterns, d as dos_share, cast(ceil(d * 10 * match_cycles * rate /
    (budget * 10 - rate * ((1 - d) * match_cycles + 1.5 * (1 - d) * 8 * 100))) as bigint) as threshold from rated)"""

EVENT_HOSTS = f"""
ehosts as (select user_id as host, min(epoch_us(ts)) // {DAY} as join_epoch, max(epoch_us(ts)) // {DAY} as left_epoch
  from events group by user_id)"""


def load_rules(kind: str) -> str:
    unique = 4096 // 8
    bits = (65536 // unique).bit_length() - 1 if kind != "all" else 32
    pattern = "(i // 8) % 32" if kind == "equal" else "i % 32"
    src_len = "32" if kind == "none" else f"(({pattern}) // 32)"
    drop = f"(({pattern}) % 32)"
    src = 0 if kind == "none" else 167837699
    dst = "167772160" if kind == "all" else f"(167772160 + ((i // 8) << {bits}))"
    rules = f"""
lens as (select range as i, {src_len} as ls, {32 - bits} as ld, least(16, 32 - {drop}) as lsp,
    greatest(0, 16 - {drop}) as ldp from range(4096)),
rules as (select i as rule_id, {sql_mask('ls', 32)} as m_srcip, {sql_mask('ld', 32)} as m_dstip,
    {sql_mask('lsp', 16)} as m_sport, {sql_mask('ldp', 16)} as m_dport, 0 as m_proto,
    {src} & m_srcip as f_srcip, {dst} & m_dstip as f_dstip, 2500 & m_sport as f_sport, 50001 & m_dport as f_dport,
    0 as f_proto from lens)"""
    return with_(PACKETS, rules) + (
        f"select r.rule_id, count(*) as value from packets p join rules r on {match_on()} group by all"
    )


def small_rules(rows: str) -> str:
    names = ", ".join(["rule_id", *[f"f_{c}" for c in KEY], *[f"m_{c}" for c in KEY]])
    return f"rules0({names}) as ({rows}), rules as (select *, " + ", ".join(f"m_{c} as g_{c}" for c in KEY) + " from rules0)"


SERVER3 = 167837699
M32, M16, M8 = 0xFFFFFFFF, 0xFFFF, 0xFF

PARTITIONS = small_rules(
    f"select range, 0, (167772160 + (range << 8)) & {_mask(24, 32)}, 2500, 0, 0, 0, {_mask(24, 32)}, {M16}, 0, 0 from range(256)"
)
CONGESTION_RULES = small_rules(
    f"values (0, 0, {SERVER3}, 0, 2500, 6, 0, {M32}, 0, {M16}, {M8}), "
    f"(1, {SERVER3}, 0, 2500, 0, 6, {M32}, 0, {M16}, 0, {M8})"
)
UDP_RULE = small_rules(f"values (2, 0, {SERVER3}, 0, 2500, 17, 0, {M32}, 0, {M16}, {M8})")

HALF = 12 * HOUR
REACTION = (
    PACKETS,
    RULES,
    HOSTS,
    sessions(HALF),
    STATE,
    CONGESTED,
    congestion_values("r.rule_id = 7", "p.epoch"),
    f"""
causes as (select c.win as epoch from cong c
  group by c.win, {", ".join(f"c.k_{c}" for c in KEY)}
  having max(c.value) >= 25 and min(case when c.host = 0 then c.value end) >= 50
    and min(case when c.host = 1 then c.value end) >= 50),
uservals as (select r.rule_id, p.host, p.us // {HALF} as epoch, {grouped()}, cast(sum(p.len) as bigint) as value
  from packets p join rules r on {match_on()} where r.rule_id = 0 group by all),
chosen as (select * from uservals where host = 2 and value >= 300)""",
)


def recursive(*ctes: str) -> str:
    return "with recursive " + ",".join(ctes) + "\n"


ORACLES: dict[str, str] = {
    "rules_from_text": with_(CUSTOMER_RULES) + "select * from crules",
    "read_trace": with_(TRACE) + "select t, src, len, proto from trace",
    "decode_frames": with_(PACKETS)
    + f"""select host, pkt_no, {K5}, len, seq, case when proto = 6 then ack else 0 end as ack, false as _corrupt
from packets where pkt_no % 11 <> 0 and pkt_no % 13 <> 0""",
    "read_controller_log": with_(LOG) + "select * from clog",
    "read_host_log": """select event_id + 100 as time, cast(event_id % 5 + 1 as int) as type,
  case when event_id % 5 in (0, 1) then event_id * 3 else 0 end as rtime, event_id % 1000 as step,
  cast(user_id as int) as event from events where event_id % 5 < 4""",
    "read_run_summaries": with_(RUNS)
    + """select 'out/feas_' || interval || '_' || flows || '_' || rules_per_flow || '_' || offered || '_' || run || '_'
    || k || '.txt' as file, interval, flows, rules_per_flow, offered, run, cents as pkts, cents * 23 as cycles,
  k % 97 + 0.5::double as rate, k % 8 + 0.25::double as loss, cast(cents * 2 as double) as zerots,
  cents % 3 as notfinished, k % 1000 + 0.75::double as sweep_ticks, cents as rx_packets, k % 50 as rx_errors,
  0.25::double as rx_loss, k % 400 + 0.125::double as match_ns, (k % 500)::double as match_cycles from runs""",
    "ip_to_long": with_(PACKETS) + f"select pkt_no, {ip_text('srcip')} as ip, srcip from packets",
    "prefix_mask": with_(PACKETS)
    + f"""select pkt_no, {sql_mask('pkt_no % 40', 32)} as m32, {sql_mask('pkt_no % 40', 16)} as m16,
  {sql_mask('pkt_no % 40', 8)} as m8 from packets""",
    "mask_flow": with_(PACKETS)
    + "select pkt_no, "
    + ", ".join(f"{c} & {sql_mask(f'pkt_no % {WIDTH[c] + 1}', WIDTH[c])} as k_{c}" for c in KEY)
    + " from packets",
    "pack_granularity": """select event_id as pkt_no, ((((event_id % 33) * 64 + event_id % 33) * 64 + event_id % 17) * 64
    + event_id % 17) * 64 + event_id % 9 as packed, cast(event_id % 33 as int) as fg_srcip,
  cast(event_id % 33 as int) as fg_dstip, cast(event_id % 17 as int) as fg_sport, cast(event_id % 17 as int) as fg_dport,
  cast(event_id % 9 as int) as fg_proto from events""",
    "group_masks": with_(CUSTOMER_RULES)
    + "select rule_id, "
    + ", ".join(f"greatest(fg_{c}, len_{c}) as g_{c}" for c in KEY)
    + " from crules where not _corrupt",
    "reverse_flow": with_(PACKETS)
    + """select pkt_no, dstip as r_srcip, srcip as r_dstip, dport as r_sport, sport as r_dport, proto as r_proto
from packets""",
    "flow_hash": with_(PACKETS)
    + f"select host, count(*) as n_flows from (select distinct {FLOW} from packets) group by host",
    "rule_matches": with_(PACKETS)
    + f"""select pkt_no, (srcip & {_mask(29, 32)}) = 167837696 and (dstip & {_mask(28, 32)}) = 167772160 as matches
from packets""",
    "epoch_of": with_(PACKETS) + "select pkt_no, us // 10000 as epoch, (len + 63) // 64 as units from packets",
    "any_match": with_(PACKETS, PARTITIONS)
    + f"select pkt_no from packets p where exists (select 1 from rules r where {match_on()})",
    "match": with_(PACKETS, RULES, flow_days())
    + f"select {', '.join('p.' + c for c in ['host', *KEY, 'epoch', 'n', 'bytes'])}, rule_id, {grouped()} "
    + f"from fd p join rules r on {match_on()}",
    "match_cap": with_(PACKETS, RULES, flow_days())
    + f"""select {FLOW}, epoch, rule_id from (
  select p.*, r.rule_id, row_number() over (partition by {", ".join('p.' + c for c in ['host', *KEY, 'epoch'])}
      order by r.first_rule, r.rule_id) as nth
  from fd p join (select *, min(rule_id) over (partition by {", ".join('m_' + c for c in KEY)}) as first_rule from rules) r
    on {match_on()}) where nth <= 2""",
    "match_mask": with_(PACKETS, RULES, flow_days())
    + f"""select {", ".join('p.' + c for c in ['host', *KEY, 'epoch', 'n', 'bytes'])}, rule_id
from fd p join rules r on (p.dstip & {_mask(24, 32)}) = r.f_dstip
where r.m_dstip = {_mask(24, 32)} and r.m_srcip = 0 and r.m_sport = 0 and r.m_dport = 0 and r.m_proto = 0""",
    "match_live": with_(PACKETS, RULES, flow_days())
    + f"""select {", ".join('p.' + c for c in ['host', *KEY, 'epoch', 'n', 'bytes'])}, rule_id, {grouped()}
from fd p join rules r on {match_on()} and p.epoch >= r.vf and p.epoch < r.vt""",
    "matched_flows": with_(PACKETS, RULES, sessions(DAY))
    + f"""select rule_id, count(*) as n_flows from (select distinct r.rule_id, {", ".join('p.' + c for c in ['host', *KEY, 'session'])}
  from ps p join rules r on {match_on()}) group by rule_id""",
    "add_rules": with_(CUSTOMER_RULES)
    + """select rule_id, rule_id % 2 = 0 or rule_id % 3 <> 1 as accepted from crules where not _corrupt""",
    "delete_rules": with_(CUSTOMER_RULES)
    + f"select rule_id, {K5} from crules where not _corrupt and not (rule_id % 4 = 0 and rule_id % 8 <> 0)",
    "lookup": VALS + f"select {VALUE}, (rule_id + host) % 2 = 0 as known from vals",
    "place": with_(CUSTOMER_RULES, HOSTS)
    + """select rule_id, threshold, cast(host as bigint) as host, threshold // 4 as local_threshold
from crules cross join hosts where not _corrupt""",
    "flow_epochs": with_(PACKETS, flow_days()) + "select * from fd",
    "sessions": with_(PACKETS, sessions(DAY)) + "select pkt_no, epoch, session from ps",
    "new_flows": with_(PACKETS, sessions(DAY))
    + f"select session as epoch, count(*) as n from (select distinct {SES} from ps) group by session",
    "retransmissions": with_(PACKETS, sessions(3 * DAY), LOST) + "select pkt_no, lost from lost",
    "retransmitted_seqs": with_(PACKETS, sessions(3 * DAY), LOST) + f"select {SES}, epoch, seq from lost where lost",
    "retransmitted_blocks": with_(PACKETS, sessions(3 * DAY), LOST)
    + f"""select {FLOW}, epoch, block, string_agg(cast(seq as varchar), ',' order by us, pkt_no) as seqs from (
  select *, (row_number() over (partition by {FLOW}, epoch order by us, pkt_no) - 1) // 32 as block from lost where lost)
group by {FLOW}, epoch, block""",
    "recently_seen": seen(False),
    "recently_seen_exact": seen(True),
    "seq_state": with_(PACKETS, sessions(2 * DAY), STATE) + f"select {SES}, epoch, seq_v1, seq_v2 from state",
    "ack_state": with_(PACKETS, sessions(2 * DAY), STATE) + f"select {SES}, epoch, ack_v1, ack_v2, dup_v1 from state",
    "dup_credit": with_(PACKETS, sessions(3 * DAY), STATE) + "select pkt_no, dup from dups",
    "with_reverse": with_(PACKETS, flow_days())
    + f"""select a.*, b.n as r_n, b.bytes as r_bytes from fd a join fd b on {REVERSED}""",
    "bursts": with_(PACKETS, bursts(2 * DAY)) + "select * from bursts",
    "in_burst": with_(PACKETS, sessions(3 * DAY), LOST, bursts(2 * DAY), IN_BURST) + "select pkt_no, hit from hits",
    "seq_gaps": with_(PACKETS)
    + """select host, cast(coalesce(sum(pkt_no - before - 1), 0) as bigint) as missing
from (select host, pkt_no, lag(pkt_no) over (partition by host order by us, pkt_no) as before from packets) group by host""",
    "evaluate": VALS + f"select {VALUE} from vals",
    "evaluate_install_phase": with_(
        PACKETS,
        RULES,
        sessions(DAY),
        LOST,
        values_cte(win="(p.epoch - r.vf + r.n_days - 1) // r.n_days", live="p.epoch >= r.vf and p.epoch < r.vt"),
    )
    + f"select {VALUE} from vals",
    **{
        f"{agg}_alerts": VALS
        + f"""select v.rule_id, host, win, {GROUP}, value, threshold from vals v join rules r using (rule_id)
where r.agg = '{agg}' and value >= threshold"""
        for agg in ("packet", "volume", "loss")
    },
    "congestion": CONGESTION + f"select {VALUE} from cong",
    "congestion_alerts": CONGESTION
    + f"select {VALUE}, threshold from cong join rules using (rule_id) where value >= threshold",
    "burst_loss": with_(PACKETS, RULES, sessions(DAY), LOST, bursts(2 * DAY), IN_BURST)
    + f"""select r.rule_id, p.host, p.epoch // r.n_days as win, {grouped()}, count(*) as value
from hits p join rules r on {match_on()} where p.hit and r.agg = 'burstloss' group by all""",
    "host_alerts": VALS
    + f"""select {VALUE}, threshold // 4 as local_threshold from vals join rules using (rule_id)
where value >= threshold // 4""",
    "value_ago": VALS
    + f"""select {", ".join('a.' + c.strip() for c in VALUE.split(','))}, coalesce(b.value, 0) as past_value
from vals a left join vals b on a.rule_id = b.rule_id and a.host = b.host and a.win = b.win + 2
  and {" and ".join(f"a.k_{c} = b.k_{c}" for c in KEY)}""",
    "dense_values": with_(PACKETS, RULES, HOSTS, sessions(DAY), LOST, values_cte())
    + f"""select g.rule_id, g.host, g.win, {", ".join('g.k_' + c for c in KEY)}, coalesce(v.value, 0) as value
from (select k.*, unnest(range(lo, hi + 1)) as win from (
    select rule_id, cast(host as bigint) as host, {", ".join(f"f_{c} as k_{c}" for c in KEY)} from rules, hosts
      where {" and ".join(f"g_{c} = m_{c}" for c in KEY)}
    union select rule_id, host, {GROUP} from vals) k
  join (select rule_id, min(win) as lo, max(win) as hi from vals group by rule_id) using (rule_id)) g
left join vals v on v.rule_id = g.rule_id and v.host = g.host and v.win = g.win
  and {" and ".join(f"v.k_{c} = g.k_{c}" for c in KEY)}""",
    "rule_report": with_(PACKETS, RULES, sessions(DAY), LOST, values_cte())
    + f"""select r.rule_id, {", ".join(f"f_{c} as {c}" for c in KEY)},
  {", ".join(f"cast(bit_count(m_{c}) as int) as len_{c}" for c in KEY)}, agg, threshold, l.win, l.value,
  coalesce(m.n_flows, 0) as n_flows
from rules r
left join (select rule_id, max(win) as win, arg_max(value, win) as value from
  (select rule_id, win, cast(sum(value) as bigint) as value from vals group by all) group by rule_id) l using (rule_id)
left join (select rule_id, count(*) as n_flows from (select distinct r.rule_id,
    {", ".join('p.' + c for c in ['host', *KEY, 'session'])} from ps p join rules r on {match_on()}) group by rule_id) m
  using (rule_id)""",
    "admit": admitted() + "select pkt_no from adm where admitted",
    "admission_counts": admitted()
    + """select epoch, count(*) filter (admitted) as admitted, count(*) filter (not admitted) as filtered
from adm group by epoch""",
    "predict_threshold": with_(PREDICTED) + "select * from predicted",
    "gather": gather("strict") + f"select {GATHERED} from kept",
    "gather_lenient": gather("lenient") + f"select {GATHERED} from kept",
    "gather_sum": gather("lenient", "total >= threshold") + f"select {GATHERED} from kept",
    "gather_all_half": gather("lenient", "least_two >= threshold // 2") + f"select {GATHERED} from kept",
    "all_data": gather("strict")
    + f"""select rule_id, win, {GROUP}, {", ".join(f"max(case when host = {h} then value end) as host_{h}" for h in range(4))}
from kept group by rule_id, win, {GROUP}""",
    "network_alerts": VALS
    + f"""select rule_id, win, {GROUP}, cast(sum(value) as bigint) as value from vals join rules using (rule_id)
group by rule_id, win, {GROUP}, threshold having sum(value) >= threshold""",
    "with_code": VALS
    + f"""select a.rule_id, a.host, a.win - 1 as win, {", ".join('a.k_' + c for c in KEY)}, b.value,
  cast(case when b.value is null then 1 else 0 end as int) as code
from vals a left join vals b on a.rule_id = b.rule_id and a.host = b.host and a.win - 1 = b.win
  and {" and ".join(f"a.k_{c} = b.k_{c}" for c in KEY)}""",
    "align": VALS + f"select rule_id, host, win + 3 * host as win, {GROUP}, value from vals",
    "expire": with_(PACKETS, RULES, sessions(DAY), LOST, values_cte(win="p.epoch"))
    + f"select {VALUE} from vals where win > (select max(win) from vals) - 10",
    "schedule": with_(CUSTOMER_RULES)
    + "select rule_id, rule_id * 5000000 + 1000000 as valid_from from crules where not _corrupt",
    "active_hosts": with_(EVENT_HOSTS)
    + f"select count(*) as n from ehosts where join_epoch <= {DAY0 + 1} and left_epoch > {DAY0 + 1}",
    "reset_on_leave": with_(CUSTOMER_RULES, EVENT_HOSTS)
    + f"""select rule_id, (select min(left_epoch) from ehosts) * {DAY} as valid_to from crules where not _corrupt""",
    "rearm": recursive(
        f"hours as (select distinct user_id % 4 as host, epoch_us(ts) // {HOUR} as epoch from events)",
        """
on_(host, epoch) as (
  select host, min(epoch) from hours group by host
  union all
  select o.host, (select min(h.epoch) from hours h where h.host = o.host and h.epoch >= o.epoch + 9) from on_ o
  where o.epoch is not null)""",
    )
    + "select host, epoch from on_ where epoch is not null",
    "reactive": recursive(
        *REACTION,
        """
on_(epoch) as (
  select min(epoch) from causes
  union all
  select (select min(c.epoch) from causes c where c.epoch >= o.epoch + 3) from on_ o where o.epoch is not null)""",
    )
    + f"""select c.*, o.epoch as armed_at from chosen c join on_ o on c.epoch >= o.epoch and c.epoch < o.epoch + 3""",
    "proactive": with_(*REACTION) + "select * from chosen",
    "partition_rules": with_(PACKETS, PARTITIONS)
    + f"""select r.rule_id, p.host, p.us // {DAY} as win, {grouped()}, count(*) as value
from packets p join rules r on {match_on()} group by all""",
    "congestion_rules": with_(
        PACKETS, CONGESTION_RULES, sessions(DAY), STATE, CONGESTED, congestion_values("true", "p.epoch")
    )
    + f"select {VALUE} from cong",
    "udp_rule": with_(PACKETS, UDP_RULE)
    + f"""select cast(r.rule_id as bigint) as rule_id, p.host, p.us // {DAY} as win, {grouped()}, cast(sum(p.len) as bigint) as value
from packets p join rules r on {match_on()} group by all""",
    "load_rules": load_rules("spread"),
    "load_rules_equal": load_rules("equal"),
    "load_rules_all": load_rules("all"),
    "load_rules_none": "select range as rule_id, cast(0 as bigint) as value from range(4096)",
    "gather_latency": with_(LOG) + "select * from lat",
    "latency_stats": with_(LOG)
    + "select event, "
    + ", ".join(
        f"round(avg({c} / 2.6e6), 6) as mean_{c}, round(stddev_samp({c} / 2.6e6), 6) as std_{c}"
        for c in ("first_ask", "last_ask", "last_sat", "last_return")
    )
    + " from lat group by event",
    "latency_cdf": with_(LOG)
    + "select distinct last_return as value, cume_dist() over (order by last_return) as cdf from lat",
    "throughput": with_(TRACE) + "select * from series",
    "normalise": with_(TRACE)
    + """select bin, src, proto, bytes, (bin + 0.5::double) * 3600000::double + 0::double + 250::double as mid_ms,
  bytes / ((select max(bytes) from series) * 1.1::double) as level from series""",
    "alert_timeline": with_(LOG)
    + """select (time - (select min(time) from clog)) / 2.6e6 as ms, server, event,
  case when event > 2 then 'reactive' else 'fixed' end as kind from clog where type = 2""",
    "min_feasible_threshold": with_(DOS)
    + """select dos_share, min(dos_len) as threshold from dos where ran > 0 and loss < 100 and unfinished < 2
group by dos_share""",
    "min_feasible_threshold_by_pattern": with_(DOS) + "select * from measured",
    "threshold_error": with_(DOS, PREDICTED)
    + """select patterns, round(avg(m.threshold - p.threshold) * (64 / 1000.0::double), 6) as mean_error_kb
from measured m join (select patterns, dos_share, min(threshold) as threshold from predicted group by all) p
  using (patterns, dos_share) group by patterns""",
    "max_feasible_rate": with_(RUNS)
    + """select interval, flows, rules_per_flow, run, max(cast(offered as bigint)) as rate from runs where cents % 3 = 0
group by all""",
    "min_feasible_size": with_(RUNS)
    + "select run, min(350 + cents % 14 * 50) as size from runs where cents % 3 = 0 group by run",
    "cycle_use": with_(RUNS)
    + """select interval, flows, round(avg(cents * 23), 3) as cycles, round(avg(cents * 2), 3) as free_cycles,
  round(avg(k % 1000 + 0.75::double), 3) as sweep_cycles from runs group by all""",
    "loss_pct": """select o_orderkey as run,
  100 * (1 - (o_orderkey + 1000)::double / (o_orderkey + 1000 + o_custkey)) as loss_pct,
  2300000000 * (o_orderkey + 1000)::double / ((o_orderkey + 1) * 1000) as rate,
  ((o_orderkey + 1) * 90) / (o_orderkey + 1000)::double as cycles_per_pkt,
  (o_orderkey + 1000)::double / (o_orderkey % 100 + 1) as pkts_per_read,
  100 * ((o_orderkey % 7) / (o_orderkey % 7 + o_orderkey + 1000 + 1)::double) as rx_loss_pct from orders""",
    "shard_load": with_(PACKETS) + "select dstip % 7 as shard, count(*) as n from packets group by 1",
}

# Which lost numbers lie in a burst of their session as far as it is known at the end of their epoch; needs `lost`.
KNOWN_BURSTS = f"""
smarks as (select *, lag(us) over (partition by {SES} order by us, pkt_no) as pu from ps),
sruns as (select *, max(case when pu is null or us - pu >= {2 * DAY} then us end)
    over (partition by {SES} order by us, pkt_no) as burst from smarks),
asked as (select distinct {SES}, epoch from lost where lost),
known as (select {", ".join("a." + c for c in ["host", *KEY, "session", "epoch"])}, q.burst, min(q.seq) as seq1, max(q.seq) as seq2
  from asked a join sruns q on {" and ".join(f"a.{c} = q.{c}" for c in ["host", *KEY, "session"])} and q.epoch <= a.epoch
  group by all having count(*) > 4),
hits as (select l.*, l.lost and exists (select 1 from known b where {" and ".join(f"b.{c} = l.{c}" for c in ["host", *KEY, "session", "epoch"])}
    and l.seq between b.seq1 and b.seq2) as hit from lost l)"""

# A window is out when its end is no later than the newest packet less the allowed delay.
SIX_HOURS = 6 * HOUR


def closed_values() -> str:
    return with_(
        PACKETS,
        RULES,
        f"""
vals as (
  select r.rule_id, p.host, p.us // ({DAY} * r.n_days) as win, {grouped()}, r.n_days,
    cast(sum(case r.agg when 'packet' then 1 else p.len end) as bigint) as value
  from packets p join rules r on {match_on()} where r.agg in ('packet', 'volume') group by all),
out as (select * from vals where (win + 1) * {DAY} * n_days <= (select max(us) from packets) - {SIX_HOURS})""",
    )


ONLINE = with_(
    PACKETS,
    RULES,
    sessions(DAY),
    LOST,
    values_cte(in_bursts=KNOWN_BURSTS),
    f"""
out as (select v.*, r.threshold from vals v join rules r using (rule_id)
  where (v.win + 1) * {DAY} * r.n_days <= (select max(us) from packets) - {SIX_HOURS})""",
)

ORACLES |= {
    "write_alerts": ORACLES["packet_alerts"],
    "stream_packets": with_(PACKETS) + f"select pkt_no, host, {K5}, len, seq, ack from packets",
    "stream_values": closed_values() + f"select {VALUE} from out",
    "stream_alerts": closed_values()
    + f"select {VALUE}, threshold from out join rules using (rule_id) where value >= threshold",
    "stream_evaluate": with_(
        PACKETS,
        RULES,
        f"""
vals as (
  select r.rule_id, p.host, p.us // ({DAY} * r.n_days) as win, {grouped()}, r.threshold,
    cast(sum(case r.agg when 'packet' then 1 else p.len end) as bigint) as value
  from packets p join rules r on {match_on()} where r.agg in ('packet', 'volume')
    and (p.us // {DAY} + 1) * {DAY} <= (select max(us) from packets) - {SIX_HOURS} group by all)""",
    )
    + f"select {VALUE}, threshold from vals where value >= threshold",
    "stream_bursts": with_(PACKETS, bursts(2 * DAY))
    + f"select * from bursts where t1 + {2 * DAY} - 1 <= (select max(us) from packets) - {SIX_HOURS}",
    "stream_flow_state": with_(
        PACKETS,
        sessions(3 * DAY),
        LOST,
        STATE,
        f"""
adm as (select pkt_no, coalesce(sum((len + 63) // 64) over (partition by {SES} order by us, pkt_no
    rows between unbounded preceding and 1 preceding), 0) >= 9 as admitted from ps)""",
    )
    + "select pkt_no, session, lost, dup, admitted from lost join dups using (pkt_no, session) join adm using (pkt_no)",
    "stream_flow_epochs": with_(PACKETS, sessions(DAY), LOST, STATE, CONGESTED, KNOWN_BURSTS)
    + f"""select {FLOW}, s.epoch, s.session, c.n, c.bytes, c.lost, c.burst_lost, u.unacked, s.seq_v1, s.seq_v2, s.ack_v1, s.ack_v2, s.dup_v1
from state s join (select {SES}, epoch, count(*) as n, cast(sum(len) as bigint) as bytes, count(*) filter (lost) as lost,
    count(*) filter (hit) as burst_lost from hits group by all) c using ({SES}, epoch)
  left join unack u using ({FLOW}, epoch)
where (s.epoch + 1) * {DAY} <= (select max(us) from packets) - {SIX_HOURS}""",
    "stream_evaluate_all": ONLINE
    + f"""select {", ".join('a.' + c.strip() for c in VALUE.split(','))}, coalesce(b.value, 0) as past_value
from out a left join out b on a.rule_id = b.rule_id and a.host = b.host and a.win = b.win + 2
  and {" and ".join(f"a.k_{c} = b.k_{c}" for c in KEY)}""",
    "stream_dense_values": with_(HOSTS) + ", " + ONLINE.removeprefix("with ")
    + f"""select g.rule_id, g.host, g.win, {", ".join('g.k_' + c for c in KEY)}, coalesce(o.value, 0) as value
from (select rule_id, cast(host as bigint) as host, {", ".join(f"f_{c} as k_{c}" for c in KEY)},
    unnest(range({DAY0} // n_days, ((select max(us) from packets) - {SIX_HOURS}) // ({DAY} * n_days))) as win
    from rules, hosts where {" and ".join(f"g_{c} = m_{c}" for c in KEY)}
  union select rule_id, host, {GROUP}, win + unnest(range(15)) as win from out) g
join rules r using (rule_id)
left join out o on o.rule_id = g.rule_id and o.host = g.host and o.win = g.win
  and {" and ".join(f"o.k_{c} = g.k_{c}" for c in KEY)}
where (g.win + 1) * {DAY} * r.n_days <= (select max(us) from packets) - {SIX_HOURS}""",
    "stream_punctual": with_(
        PACKETS,
        f"""
marks as (select pkt_no % 4 as slice, max(us) // 1000 * 1000 - {SIX_HOURS} as mark from packets group by all),
seen as (select p.*, us // {DAY} as epoch, (select max(mark) from marks where slice < pkt_no % 4) as mark from packets p),
told as (select *, coalesce((epoch + 1) * {DAY} <= mark, false) as late from seen)""",
    )
    + f"""select {FLOW}, epoch, count(*) as n, cast(sum(len) as bigint) as bytes, late, cast(null as bigint) as pkt_no, cast(null as bigint) as delay_us
from told where not late and (epoch + 1) * {DAY} <= (select max(mark) from marks) group by all
union all select {FLOW}, epoch, 1, len, late, pkt_no, mark - us from told where late""",
    "stream_alerts_all": ONLINE + f"select {VALUE}, threshold from out where value >= threshold",
    "answer_requests": closed_values()
    + f"""select o.rule_id, o.host, o.win, {", ".join("o.k_" + c for c in KEY)}, o.value
from out o join events e on o.rule_id in (0, 3) and e.user_id % 4 = o.host
  and epoch_us(e.ts) // {DAY} = o.win""",
}

CHANGING = f"chosts(host, join_epoch, left_epoch) as (values (0, 0, null), (1, 0, {DAY0 + 20}), (2, 0, null), (3, {DAY0 + 10}, null))"


def gather_changing(mode: str, in_bursts: str = "") -> str:
    whole = "having count(distinct v.host) = max(n_hosts) and" if mode == "strict" else "having"
    return with_(
        PACKETS,
        RULES,
        CHANGING,
        sessions(DAY),
        LOST,
        values_cte(in_bursts=in_bursts),
        f"""
days as (select distinct rule_id, win, (win + 1) * n_days - 1 as last_day, threshold from vals join rules using (rule_id)),
here as (select d.rule_id, d.win, d.threshold, h.host, count(*) over (partition by d.rule_id, d.win) as n_hosts
  from days d join chosts h on h.join_epoch <= d.last_day and (h.left_epoch is null or h.left_epoch > d.last_day)),
keys as (select v.rule_id, v.win, {GROUP}, count(distinct v.host) = max(n_hosts) as complete from vals v join here h on v.rule_id = h.rule_id and v.win = h.win and v.host = h.host
  group by v.rule_id, v.win, {GROUP}, threshold {whole} max(value) >= threshold // max(n_hosts))""",
    ) + f"""select k.* exclude (complete), cast(h.host as bigint) as host, coalesce(v.value, 0) as value{', cast(v.value is null as int) as code, complete' if in_bursts else ''}
from keys k join here h on h.rule_id = k.rule_id and h.win = k.win
left join vals v on v.rule_id = k.rule_id and v.win = k.win and v.host = h.host and {" and ".join(f"v.k_{c} = k.k_{c}" for c in KEY)}"""


ORACLES["stream_gather"] = (
    gather_changing("lenient", KNOWN_BURSTS)
    + f"""
join rules r on r.rule_id = k.rule_id
where (k.win + 1) * {DAY} * r.n_days + case when complete then 0 else {DAY} end <= (select max(us) from packets) - {SIX_HOURS}"""
)

ORACLES |= {
    "time_histogram": with_(
        PACKETS,
        f"""
bins as (select {FLOW}, us as e, sum(len)::bigint as b from packets where len > 0 group by {FLOW}, us),
lists as (select {FLOW}, list([{{'e': e, 'b': b}}] order by e) as parts from bins group by {FLOW}),
merged as (select {FLOW}, list_reduce(parts, lambda a, x: (
    CASE WHEN len(a || x) <= 8 THEN a || x ELSE
      list_transform(range(1, 9), lambda i: CASE
        WHEN i < list_position(list_transform(range(1, 9), lambda j: (a || x)[j].b + (a || x)[j + 1].b),
            list_min(list_transform(range(1, 9), lambda j: (a || x)[j].b + (a || x)[j + 1].b))) THEN (a || x)[i]
        WHEN i = list_position(list_transform(range(1, 9), lambda j: (a || x)[j].b + (a || x)[j + 1].b),
            list_min(list_transform(range(1, 9), lambda j: (a || x)[j].b + (a || x)[j + 1].b)))
          THEN {{'e': (a || x)[i + 1].e, 'b': ((a || x)[i].b + (a || x)[i + 1].b)::bigint}}
        ELSE (a || x)[i + 1] END) END)) as kept
  from lists),
numbered as (select {FLOW}, generate_subscripts(kept, 1) - 1 as bucket, unnest(kept) as k from merged)""",
    )
    + f"select {FLOW}, bucket, k.e as ts_end, k.b as bytes from numbered",
    "admit_hashed": with_(
        PACKETS,
        f"""
keyed as (select *, ((((srcip * 31 + dstip) * 31 + sport) * 31 + dport) * 31 + proto) % 64 as bucket, us // {3 * DAY} as epoch from packets),
ke as (select distinct host, bucket, epoch from keyed),
kl as (select *, lag(epoch) over (partition by host, bucket order by epoch) as pe from ke),
ks as (select host, bucket, epoch, max(case when pe is null or epoch - pe > 1 then epoch end)
    over (partition by host, bucket order by epoch) as session from kl),
adm as (select pkt_no, coalesce(sum((len + 63) // 64) over (partition by host, bucket, session order by us, pkt_no
    rows between unbounded preceding and 1 preceding), 0) >= 9 as admitted from keyed join ks using (host, bucket, epoch))""",
    )
    + "select pkt_no from adm where admitted",
    "gather_changing": gather_changing("strict"),
    "gather_changing_lenient": gather_changing("lenient"),
    "place_changing": with_(CUSTOMER_RULES)
    + """select rule_id, threshold, cast(host as bigint) as host, threshold // 3 as local_threshold
from crules cross join (values (0), (2), (3)) h(host) where not _corrupt""",
    "slow_batches": "select count(*) as input_rows from events",
    "stream_lifetimes": with_(
        PACKETS,
        RULES,
        f"""
vals as (
  select r.rule_id, p.host, p.us // {DAY} as win, {grouped()},
    cast(sum(case r.agg when 'packet' then 1 else p.len end) as bigint) as value
  from packets p join rules r on {match_on()} and p.us // {DAY} >= r.vf and p.us // {DAY} < r.vt
  where r.agg in ('packet', 'volume') group by all)""",
    )
    + f"select {VALUE} from vals where (win + 1) * {DAY} <= (select max(us) from packets) - {SIX_HOURS}",
    "custom_rule_type": with_(
        PACKETS,
        RULES,
        f"""
vals as (select r.rule_id, p.host, p.us // {DAY} as win, {grouped()}, r.threshold, count(*) filter (p.len > 200) as value
  from packets p join rules r on {match_on()} group by all)""",
    )
    + f"select {VALUE}, threshold from vals where value > threshold",
    "alert_hooks": VALS
    + """select 'start' as event, count(*) as n from rules where agg = 'packet'
union all select 'finish', count(*) from rules where agg = 'packet' union all select 'host_join', 4
union all select 'alert', count(*) from vals join rules using (rule_id) where agg = 'packet' and value >= threshold""",
}

# Cutting keys into pieces changes no answer.
ORACLES |= {
    f"{name}_cut": ORACLES[name]
    for name in ["sessions", "retransmissions", "recently_seen", "dup_credit", "bursts", "in_burst", "admit", "seq_gaps", "latency_cdf"]
}

HALF_CLOSED = f"(select max(us) from packets) - {SIX_HOURS}"
ORACLES["stream_react"] = (
    recursive(
        PACKETS,
        RULES,
        sessions(HALF),
        STATE,
        CONGESTED,
        congestion_values("r.rule_id = 7", "p.epoch"),
        f"""
causes as (select distinct win as epoch from cong join rules using (rule_id)
  where value >= threshold and (win + 1) * {HALF} <= {HALF_CLOSED}),
vals as (select r.rule_id, p.host, p.us // {HALF} as win, {grouped()}, cast(sum(p.len) as bigint) as value
  from packets p join rules r on {match_on()} where r.rule_id = 0 group by all),
on_(epoch) as (
  select min(epoch) from causes
  union all
  select (select min(c.epoch) from causes c where c.epoch >= o.epoch + 3) from on_ o where o.epoch is not null)""",
    )
    + f"""select v.*, cast(300 as bigint) as threshold, o.epoch as armed_at
from vals v join on_ o on v.win >= o.epoch and v.win < o.epoch + 3
where v.host = 2 and v.value >= 300 and (v.win + 1) * {HALF} <= {HALF_CLOSED}"""
)
LIVES = "(select rule_id, vf, vt from rules union all select rule_id, vt + 2, vt + 3 from rules)"
ORACLES["rule_changes"] = with_(RULES) + f"select rule_id, vf * {DAY} as since, vt * {DAY} as until from {LIVES}"
ORACLES["stream_rule_changes"] = with_(
    PACKETS,
    RULES,
    f"""
vals as (
  select r.rule_id, p.host, p.us // {DAY} as win, {grouped()},
    cast(sum(case r.agg when 'packet' then 1 else p.len end) as bigint) as value
  from packets p join rules r on {match_on()} join {LIVES} l on l.rule_id = r.rule_id
    and p.us // {DAY} >= l.vf and p.us // {DAY} < l.vt
  where r.agg in ('packet', 'volume') group by all)""",
) + f"select {VALUE} from vals where (win + 1) * {DAY} <= (select max(us) from packets) - {SIX_HOURS}"
