"""The whole fold as a recursive DuckDB query: an oracle that shares nothing with the Python fold but the rules.

Each step of the recursion takes the next command of every book; a book's resting orders are a list. Crossing orders are
sorted by priority, a running sum says how much of each is filled. Events are then assembled from the steps. Meant for
small tables: a step copies the books.
"""

from __future__ import annotations

from ledgerloom.plans import derive

FOLD = f"""
recursive commands as materialized ({derive.COMMANDS_SQL}),
fold as (
  select book, cast(0 as bigint) as seq, cast([] as struct(side varchar, price bigint, arrival bigint, id bigint, quantity bigint)[]) as orders, cast(0 as bigint) as arrivals,
    cast(null as bigint) as bid_price, cast(null as bigint) as bid_qty, cast(null as bigint) as ask_price, cast(null as bigint) as ask_qty, cast(null as varchar) as reason,
    cast([] as struct(id bigint, price bigint, quantity bigint)[]) as trades, cast(0 as bigint) as residual, cast(null as struct(side varchar, price bigint, arrival bigint, id bigint, quantity bigint)) as gone
  from (select distinct book from commands) as b
  union all
  select book, seq, orders, arrivals,
    list_max([o.price for o in orders if o.side = 'BUY']) as bid_price, cast(list_sum([o.quantity for o in orders if o.side = 'BUY' and o.price = list_max([p.price for p in orders if p.side = 'BUY'])]) as bigint) as bid_qty,
    list_min([o.price for o in orders if o.side = 'SELL']) as ask_price, cast(list_sum([o.quantity for o in orders if o.side = 'SELL' and o.price = list_min([p.price for p in orders if p.side = 'SELL'])]) as bigint) as ask_qty,
    reason, trades, residual, gone
  from (
    select book, seq, reason, trades, residual, gone, arrivals + cast(rests as bigint) as arrivals,
      case when reason is not null then orders when kind = 'C' then list_filter(orders, lambda o: o.id <> cid)
        else list_concat(list_filter(list_transform(orders, lambda o: struct_pack(side := o.side, price := o.price, arrival := o.arrival, id := o.id, quantity := o.quantity - coalesce(list_filter(trades, lambda t: t.id = o.id)[1].quantity, 0))), lambda o: o.quantity > 0),
          case when rests then [struct_pack(side := cside, price := cprice, arrival := arrivals + 1, id := cid, quantity := residual)] else [] end) end as orders
    from (
      select *, reason is null and kind = 'N' and residual > 0 and ctype = 'LIMIT' and ctif = 'GTC' as rests
      from (
        select *, case when kind = 'N' and reason is null then cq - coalesce(cast(list_sum(list_transform(trades, lambda t: t.quantity)) as bigint), 0) else 0 end as residual
        from (
          select *, list_filter(list_transform(opp, lambda o, i: struct_pack(id := o.id, price := o.price, quantity := least(o.quantity, greatest(0, cq - coalesce(cast(list_sum(list_transform(opp[1:i - 1], lambda x: x.quantity)) as bigint), 0))))), lambda t: t.quantity > 0) as trades
          from (
            select *, case when kind = 'N' and reason is null then list_sort(list_transform(list_filter(orders, lambda o: o.side <> cside and (ctype = 'MARKET' or (cside = 'BUY' and o.price <= cprice) or (cside = 'SELL' and o.price >= cprice))),
                lambda o: struct_pack(k := case when cside = 'BUY' then o.price else -o.price end, arrival := o.arrival, id := o.id, price := o.price, quantity := o.quantity))) else [] end as opp,
              case when kind = 'C' then list_filter(orders, lambda o: o.id = cid)[1] end as gone
            from (
              select f.book, c.seq, f.orders, f.arrivals, c.kind, c.id as cid, c.side as cside, c.type as ctype, c.tif as ctif, c.price as cprice, c.quantity as cq,
                case when c.kind = 'C' then case when len(list_filter(f.orders, lambda o: o.id = c.id)) = 0 then 'UNKNOWN_ORDER_ID' end
                  when c.instrument <> c.book then 'WRONG_INSTRUMENT' when c.quantity = 0 then 'ZERO_QUANTITY' when c.type = 'LIMIT' and c.price <= 0 then 'NON_POSITIVE_PRICE'
                  when c.type = 'MARKET' and c.tif <> 'IOC' then 'MARKET_ORDER_MUST_BE_IOC' when len(list_filter(f.orders, lambda o: o.id = c.id)) > 0 then 'DUPLICATE_ORDER_ID' end as reason
              from fold as f join commands as c on c.book = f.book and c.seq = f.seq + 1
            ) as x1
          ) as x2
        ) as x3
      ) as x4
    ) as x5
  ) as x6
)"""

#: Common table expressions up to `events`, with the columns of matching.match() but for the text.
EVENTS = f"""{FOLD},
tops as (select *, lag(struct_pack(a := bid_price, b := bid_qty, c := ask_price, d := ask_qty)) over (partition by book order by seq) as before from fold),
steps as (select t.book, t.seq, t.reason, t.trades, t.residual, t.gone, t.bid_price, t.bid_qty, t.ask_price, t.ask_qty, struct_pack(a := t.bid_price, b := t.bid_qty, c := t.ask_price, d := t.ask_qty) is distinct from t.before as moved,
  c.kind, c.id, c.side, c.type, c.tif, c.price, c.quantity, c.kind = 'N' and t.reason is null as entered, c.type = 'LIMIT' and c.tif = 'GTC' as may_rest
  from tops as t join commands as c on c.book = t.book and c.seq = t.seq),
told as (
  select book, seq, 0 as place, case when entered then 'ACCEPTED' when kind = 'N' then 'REJECTED' when reason is null then 'CANCELLED' else 'CANCEL_REJECTED' end as event_type, id, cast(null as bigint) as resting_id,
    case when entered then side when kind = 'C' then gone.side end as side, case when entered then type end as type, case when entered then tif end as tif,
    case when entered then price when kind = 'C' then gone.price end as price, case when entered then quantity when kind = 'C' then gone.quantity end as quantity, reason,
    case when kind = 'C' and reason is null then false end as engine_initiated, cast(null as bigint) as bid_price, cast(null as bigint) as bid_qty, cast(null as bigint) as ask_price, cast(null as bigint) as ask_qty from steps
  union all
  select book, seq, i, 'TRADE', id, trades[i].id, side, null, null, trades[i].price, trades[i].quantity, null, null, null, null, null, null from (select *, unnest(range(1, len(trades) + 1)) as i from steps) as x
  union all
  select book, seq, 1000000, case when may_rest then 'RESTING' else 'CANCELLED' end, id, null, side, null, null, price, residual, null, case when not may_rest then true end, null, null, null, null from steps where entered and residual > 0
  union all
  select book, seq, 2000000, 'TOB', null, null, null, null, null, null, null, null, null, bid_price, bid_qty, ask_price, ask_qty from steps where moved),
events_ as (select book, row_number() over (partition by book order by seq, place) as event_seq, seq as command_seq, * exclude (book, seq, place) from told),
resting_ as (select book, o.side, dense_rank() over (partition by book, o.side order by case when o.side = 'BUY' then -o.price else o.price end) as level_rank, row_number() over (partition by book, o.side, o.price order by o.arrival) as queue_pos, o.price, o.arrival, o.id, o.quantity
  from (select book, unnest(orders) as o from fold qualify seq = max(seq) over (partition by book)) as x)"""

_TEXT = """'seq=' || event_seq || ' cmd=' || command_seq || ' ' || case event_type
  when 'ACCEPTED' then 'ACCEPTED id=' || id || ' side=' || side || ' type=' || type || ' tif=' || tif || ' px=' || price || ' qty=' || quantity
  when 'TRADE' then 'TRADE aggressor=' || id || ' resting=' || resting_id || ' side=' || side || ' px=' || price || ' qty=' || quantity
  when 'RESTING' then 'RESTING id=' || id || ' side=' || side || ' px=' || price || ' qty=' || quantity
  when 'CANCELLED' then 'CANCELLED id=' || id || ' side=' || side || ' px=' || price || ' qty=' || quantity || ' by=' || case when engine_initiated then 'ENGINE' else 'CLIENT' end
  when 'TOB' then 'TOB bid=' || coalesce(bid_price || 'x' || bid_qty, 'none') || ' ask=' || coalesce(ask_price || 'x' || ask_qty, 'none')
  else event_type || ' id=' || id || ' reason=' || reason end"""



def _le(value: str) -> str:
    """The eight bytes of a number, little-endian, as a list."""
    return f"list_transform(range(0, 8), lambda i_: (cast({value} as uhugeint) >> cast(8 * i_ as uhugeint)) & 255::uhugeint)"


def _fnv(start: str, items: str) -> str:
    """The hash of a list of bytes, in 128-bit arithmetic that is cut to 64 bits."""
    return f"list_reduce(list_concat([cast({start} as uhugeint)], {items}), lambda h_, b_: (xor(h_, b_) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"


_START = "1469598103934665603"
_NUMBER = "list_position(['ACCEPTED', 'REJECTED', 'TRADE', 'RESTING', 'CANCELLED', 'CANCEL_REJECTED', 'TOB'], event_type) - 1"
CHECKSUMS = f"""with {EVENTS},
lines as (select book, event_seq, list_concat({_le(_NUMBER)}, list_transform(string_split({_TEXT}, ''), lambda c_: cast(ord(c_) as uhugeint))) as bytes from events_),
streams as (select book, max(event_seq) as events, {_fnv(_START, "flatten(list(bytes order by event_seq))")} as event_hash from lines group by book),
levels as (select book, side, level_rank, list_concat({_le("price")}, list_concat({_le("count(*)")}, flatten(list(list_concat({_le("id")}, list_concat({_le("quantity")}, {_le("arrival")})) order by queue_pos)))) as bytes from resting_ group by book, side, level_rank, price),
sides as (select b.book, s.side, list_concat({_le("count(l.book)")}, coalesce(flatten(list(l.bytes order by l.level_rank) filter (where l.book is not null)), [])) as bytes
  from (select distinct book from commands) as b cross join (values ('BUY'), ('SELL')) as s(side) left join levels as l on l.book = b.book and l.side = s.side group by b.book, s.side),
books as (select book, {_fnv(_START, "flatten(list(bytes order by side))")} as book_checksum from sides group by book),
ends as (select book, seq, arrivals from fold qualify seq = max(seq) over (partition by book))
select e.book, e.seq as commands, s.events, e.arrivals, cast(s.event_hash as varchar) as event_hash, cast(b.book_checksum as varchar) as book_checksum,
  cast({_fnv("b.book_checksum", f"list_concat({_le('e.seq')}, list_concat({_le('s.events')}, list_concat({_le('e.arrivals')}, {_le('e.book')})))")} as varchar) as state_checksum
from ends as e join streams as s on s.book = e.book join books as b on b.book = e.book"""

#: The checksum of each command's line, bit by bit.
CRC = f"""with commands as ({derive.COMMANDS_SQL}), lines as (select book, seq, case when kind = 'C' then 'C ' || id else 'N ' || id || ' ' || side || ' ' || type || ' ' || tif || ' ' || price || ' ' || quantity end as line from commands)
select book, seq, xor(list_reduce(list_concat([4294967295], list_transform(string_split(line, ''), lambda c_: cast(ord(c_) as bigint))), lambda v_, b_: list_reduce(list_concat([xor(v_, b_)], range(8)), lambda x_, k_: xor(x_ >> 1, 3988292384 * (x_ & 1)))), 4294967295) as crc from lines"""

SQL = {
    "checksums": f"select * exclude (arrivals) from ({CHECKSUMS}) as c",
    "recovery_as_of": f"select * exclude (arrivals, event_hash) from ({CHECKSUMS}) as c",
    "snapshot_roundtrip": f"""select c.book, commands as last_seq, commands as command_seq, events as event_seq, arrivals, orders, quantity, book_checksum, state_checksum from ({CHECKSUMS}) as c
        join (with {EVENTS} select b.book, count(r.id) as orders, cast(coalesce(sum(r.quantity), 0) as bigint) as quantity from (select distinct book from commands) as b left join resting_ as r on r.book = b.book group by b.book) as o on o.book = c.book""",
    # order files name no instrument: each order is for the instrument of its file
    "replay_files": "select * exclude (arrivals) from (" + CHECKSUMS.replace("case when event_id % 97 = 0 then book + 1 else book end", "book") + ") as c",
    "event_files": f"with {EVENTS} select book, {_TEXT} as text from events_",
    "stream_matches_batch": f"with {EVENTS} select book, event_seq, {_TEXT} as text from events_",
    "prefix_replay": f"with {EVENTS} select book, event_seq, command_seq, {_TEXT} as text from events_ where command_seq > (select max(seq) // 2 from commands as c where c.book = events_.book)",
    "book_from_events": f"with {EVENTS} select book, side, price, id, quantity, queue_pos from resting_",
    "crc32_payload": CRC,
    "match_events": f"with {EVENTS} select *, {_TEXT} as text from events_",
    "events_by_type": f"with {EVENTS} select book, event_type, count(*) as events from events_ group by all",
    "trades": f"with {EVENTS} select book, event_seq, command_seq, id as aggressor_id, resting_id, side, price, quantity from events_ where event_type = 'TRADE'",
    "nth_event_of_type": f"with {EVENTS} select book, event_seq, command_seq, id, resting_id, price, quantity from events_ where event_type = 'TRADE' qualify row_number() over (partition by book order by event_seq) = 3",
    "tob_changes": f"with {EVENTS} select book, event_seq, command_seq, bid_price, bid_qty, ask_price, ask_qty, lag(bid_price) over w as prev_bid_price, lag(ask_price) over w as prev_ask_price from events_ where event_type = 'TOB' window w as (partition by book order by event_seq)",
    "quotes_at_trades": f"""with {EVENTS}, quotes as (select book, command_seq, bid_price, ask_price from events_ where event_type = 'TOB')
        select e.book, e.event_seq, e.side, e.price, e.quantity, q.bid_price, q.ask_price from events_ as e asof left join quotes as q on q.book = e.book and q.command_seq < e.command_seq where e.event_type = 'TRADE'""",
    "bars": f"""with {EVENTS} select book, (command_seq - 1) // 100 as bar, min_by(price, event_seq) as open, max(price) as high, min(price) as low, max_by(price, event_seq) as close, cast(sum(quantity) as bigint) as volume
        from events_ where event_type = 'TRADE' group by 1, 2""",
    "final_book": f"with {EVENTS} select * from resting_",
    "final_depth": f"with {EVENTS} select book, side, price, cast(sum(quantity) as bigint) as quantity, count(*) as orders from resting_ group by all",
}

#: What streams and books must satisfy, evaluated on this fold's own events and books; the results are empty.
VIOLATIONS = {
    "conservation": f"""with {EVENTS}, flows as (select book, coalesce(sum(quantity) filter (where event_type = 'ACCEPTED'), 0) as accepted, coalesce(sum(quantity) filter (where event_type = 'TRADE'), 0) as traded,
        coalesce(sum(quantity) filter (where event_type = 'CANCELLED'), 0) as cancelled from events_ group by book), rest as (select book, sum(quantity) as resting from resting_ group by book)
        select f.book from flows as f left join rest as r on r.book = f.book where accepted <> 2 * traded + cancelled + coalesce(resting, 0)""",
    "uncrossed_book": f"with {EVENTS} select book from resting_ group by book having max(price) filter (where side = 'BUY') >= min(price) filter (where side = 'SELL')",
    "queue_order": f"with {EVENTS} select book, id from resting_ qualify quantity <= 0 or arrival <= lag(arrival) over (partition by book, side, price order by queue_pos)",
    "trade_within_limit": f"""with {EVENTS} select e.book, e.event_seq from events_ as e join commands as c on c.book = e.book and c.seq = e.command_seq
        where e.event_type = 'TRADE' and c.kind = 'N' and c.type = 'LIMIT' and ((c.side = 'BUY' and e.price > c.price) or (c.side = 'SELL' and e.price < c.price))""",
    "gapless_events": f"with {EVENTS} select book, event_seq from events_ qualify event_seq <> coalesce(lag(event_seq) over (partition by book order by event_seq), 0) + 1",
    "silent_commands": f"with {EVENTS} select c.book, c.seq as command_seq from commands as c where not exists (select 1 from events_ as e where e.book = c.book and e.command_seq = c.seq)",
    "late_tops": f"with {EVENTS} select book, event_seq from events_ qualify event_type = 'TOB' and lead(event_seq) over (partition by book, command_seq order by event_seq) is not null",
}
