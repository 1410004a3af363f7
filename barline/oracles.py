"""DuckDB SQL of the state machines: one recursion over fills, bars or steps, with a run's state in each row.

Written from the rules' definitions, apart from the simulators: what a step does is worked out in the order of a
bar, one subquery for each decision. Only the driver's comparison uses them.
"""

from __future__ import annotations


def ledger(fills: str) -> str:
    """CTEs f, s and last: the state after each position's fills (account, symbol, seq, side, q, p), 5 of fees each.
    Ends with `states`, one row for each position."""
    return f"""f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY seq) AS k, count(*) OVER (PARTITION BY account, symbol) AS n FROM ({fills})),
    s AS (SELECT account, symbol, 0::BIGINT AS k, 0.0::DOUBLE AS held, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS realized, 0.0::DOUBLE AS fees, 0.0::DOUBLE AS cash FROM f WHERE k = 1
      UNION ALL
      SELECT s.account, s.symbol, f.k, CASE WHEN side = 'BUY' THEN held + q ELSE held - least(q, held) END,
        CASE WHEN side = 'BUY' THEN (held * cost + q * p) / (held + q) WHEN held > q THEN cost ELSE 0.0 END,
        realized + CASE WHEN side = 'SELL' THEN least(q, held) * (p - cost) ELSE 0.0 END, fees + 5.0, cash + CASE WHEN side = 'BUY' THEN -q * p - 5.0 ELSE q * p - 5.0 END
      FROM s JOIN f ON f.account = s.account AND f.symbol = s.symbol AND f.k = s.k + 1),
    states AS (SELECT account, symbol, arg_max(held, k) AS position, arg_max(cost, k) AS average_cost, arg_max(realized, k) AS realized_pnl, arg_max(fees, k) AS fees, arg_max(cash, k) AS cash FROM s GROUP BY 1, 2)"""


def _at(values: dict[str, object], names: tuple[str, ...], default: str = "NULL") -> str:
    return "[" + ", ".join(str(values.get(n, default)) for n in names) + "]"


def portfolio(signals: str, names: tuple[str, ...], size: float, cap: float, stops: dict, trailing: tuple[str, ...], targets: dict, trailed: tuple[str, ...], scaled: str, fee: dict, slip: dict, cooled: str) -> str:
    """The portfolio simulator of one run over `sig` (the CTEs `signals` end with it: bars with buy and sell; not all
    symbols have all times). names: the symbols in their order; stops, targets, fee, slip: percent by symbol; trailing,
    trailed: whose stops and targets trail; scaled: the symbol with Scaling(3, (50, 25), (50,), cap, 2); cooled: the
    one with Cooldown(5). One step is one symbol's turn in a bar, as turns share the cash."""
    m = len(names)
    number = "CASE symbol " + " ".join(f"WHEN '{n}' THEN {k + 1}" for k, n in enumerate(names)) + " END"
    chosen = ", ".join(f"'{n}'" for n in names)
    put = lambda column, new: f"[CASE WHEN i = s THEN {new} ELSE {column}[i] END FOR i IN range(1, {m + 1})]"
    flags = lambda which: _at(dict.fromkeys(which, "true"), names, "false")
    once = ", ".join(["0.0::DOUBLE"] * m)
    return f"""{signals}, mine AS (SELECT * FROM sig WHERE symbol IN ({chosen})), grid AS (SELECT * FROM (SELECT DISTINCT datetime FROM mine), (SELECT DISTINCT symbol FROM mine)),
    dense AS (SELECT g.symbol, g.datetime, {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, first_value({c} IGNORE NULLS) OVER v) AS {c}" for c in ("high", "low", "close"))},
      coalesce(buy, false) AS buy, coalesce(sell, false) AS sell, coalesce(volume % 3 = 0, false) AS scale_in, coalesce(volume % 5 = 0 AND volume % 3 <> 0, false) AS scale_out
      FROM grid g LEFT JOIN mine USING (symbol, datetime) WINDOW w AS (PARTITION BY g.symbol ORDER BY g.datetime ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY g.symbol ORDER BY g.datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    steps AS (SELECT *, {number} AS s, dense_rank() OVER (ORDER BY datetime) - 1 AS k, list(close) OVER (PARTITION BY datetime ORDER BY {number} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closes FROM dense),
    b AS MATERIALIZED (SELECT *, k * {m} + s AS j, {_at(stops, names)}[s]::DOUBLE AS stop, {flags(trailing)}[s] AS stop_trails, {_at(targets, names)}[s]::DOUBLE AS target, {flags(trailed)}[s] AS target_trails,
      {_at(fee, names, "0.0")}[s]::DOUBLE / 100 AS fee_rate, {_at(slip, names, "0.0")}[s]::DOUBLE / 100 AS slip, symbol = '{scaled}' AS scales, symbol = '{cooled}' AS cools FROM steps),
    st AS (
      SELECT 0::BIGINT AS j, 100000.0::DOUBLE AS cash, [{once}] AS q, [{once}] AS spent, [{once}] AS entry, [{once}] AS peak, [{", ".join(["NULL::DOUBLE"] * m)}] AS trail,
        [{", ".join(["0::BIGINT"] * m)}] AS entries, [{", ".join(["0::BIGINT"] * m)}] AS outs, [{", ".join(["0::BIGINT"] * m)}] AS wait, [{", ".join(["NULL::BIGINT"] * m)}] AS acted,
        NULL::TIMESTAMP AS datetime, NULL::VARCHAR AS symbol, 0::BIGINT AS s, NULL::DOUBLE AS held, NULL::VARCHAR AS side, NULL::DOUBLE AS price, NULL::DOUBLE AS quantity, NULL::DOUBLE AS fee, NULL::DOUBLE AS pnl, NULL::VARCHAR AS reason
      UNION ALL
      SELECT j, new_cash, {put("q", "new_q")} AS q2, {put("spent", "CASE WHEN new_q <= 1e-12 THEN 0.0 ELSE new_spent END")}, {put("entry", "CASE WHEN side = 'BUY' THEN fill WHEN new_q <= 1e-12 THEN 0.0 ELSE entry[s] END")},
        {put("peak", "CASE WHEN side = 'BUY' THEN high WHEN new_q <= 1e-12 THEN 0.0 ELSE top END")}, {put("trail", "CASE WHEN side = 'BUY' OR new_q <= 1e-12 THEN NULL ELSE trails END")},
        {put("entries", "CASE WHEN side = 'BUY' THEN entries[s] + 1 WHEN new_q <= 1e-12 THEN 0 ELSE entries[s] END")}, {put("outs", "CASE WHEN side = 'BUY' OR new_q <= 1e-12 THEN 0 WHEN reason = 'scale_out' THEN outs[s] + 1 ELSE outs[s] END")},
        {put("wait", "CASE WHEN way_out IS NOT NULL THEN CASE WHEN scales THEN 2 ELSE 0 END WHEN reason = 'buy_signal' AND scales THEN 2 ELSE left_to_wait END")}, {put("acted", "CASE WHEN way_out IS NOT NULL OR reason = 'buy_signal' THEN k ELSE acted[s] END")},
        datetime, symbol, s, list_sum([{put("q", "new_q")}[i] * closes[i] FOR i IN range(1, {m + 1})]), side, CASE WHEN side IS NOT NULL THEN fill END, CASE WHEN side IS NOT NULL THEN amount END, CASE WHEN side IS NOT NULL THEN paid END,
        CASE side WHEN 'BUY' THEN -paid WHEN 'SELL' THEN amount * fill - paid - gone END, reason
      FROM (SELECT *, CASE side WHEN 'BUY' THEN cash - capital WHEN 'SELL' THEN cash + (amount * fill - paid) ELSE cash END AS new_cash,
          CASE side WHEN 'BUY' THEN q[s] + amount WHEN 'SELL' THEN q[s] - amount ELSE q[s] END AS new_q, CASE side WHEN 'BUY' THEN spent[s] + (capital - paid) WHEN 'SELL' THEN spent[s] - gone ELSE spent[s] END AS new_spent
        FROM (SELECT *, CASE side WHEN 'BUY' THEN (capital - paid) / fill ELSE q[s] * share END AS amount, CASE WHEN side = 'SELL' THEN spent[s] * share END AS gone
          FROM (SELECT *, CASE side WHEN 'BUY' THEN capital * fee_rate WHEN 'SELL' THEN q[s] * share * fill * fee_rate END AS paid
            FROM (SELECT *, CASE side WHEN 'BUY' THEN close * (1 + slip) WHEN 'SELL' THEN coalesce(way_out, close) * (1 - slip) END AS fill
              FROM (SELECT *, CASE WHEN reason IN ('buy_signal', 'scale_in') THEN 'BUY' WHEN reason IS NOT NULL THEN 'SELL' END AS side, CASE WHEN reason = 'scale_out' THEN 0.5 ELSE 1.0 END AS share
                FROM (SELECT *, CASE WHEN way_out IS NOT NULL THEN exit_reason WHEN blocked THEN NULL WHEN q[s] = 0 AND buy AND capital > 0 THEN 'buy_signal'
                    WHEN q[s] > 0 AND scales AND scale_in AND entries[s] < 3 AND room > 0 AND capital > 0 THEN 'scale_in' WHEN q[s] > 0 AND scales AND scale_out THEN 'scale_out' END AS reason
                  FROM (SELECT *, least(CASE WHEN q[s] = 0 THEN total * {size} / 100 ELSE least(total * {size} / 100 * CASE WHEN entries[s] = 1 THEN 50.0 ELSE 25.0 END / 100, total * room / 100) END, cash) AS capital
                    FROM (SELECT *, {cap} - q[s] * close / total * 100 AS room, left_to_wait > 0 OR (cools AND acted[s] IS NOT NULL AND k - acted[s] < 5) AS blocked
                      FROM (SELECT *, CASE WHEN stopped IS NOT NULL THEN stopped WHEN taken IS NOT NULL THEN taken WHEN q[s] > 0 AND sell THEN close END AS way_out,
                          CASE WHEN stopped IS NOT NULL THEN 'stop_loss' WHEN taken IS NOT NULL THEN 'take_profit' ELSE 'sell_signal' END AS exit_reason,
                          cash + list_sum([q[i] * closes[i] FOR i IN range(1, {m + 1})]) AS total
                        FROM (SELECT *, CASE WHEN q[s] > 0 AND (close <= stop_at OR (low <= stop_at AND stop_at <= high)) THEN least(close, stop_at) END AS stopped,
                            CASE WHEN q[s] > 0 AND (close >= trails OR (low <= trails AND trails <= high)) THEN greatest(close, trails) END AS taken
                          FROM (SELECT *, (CASE WHEN stop_trails THEN top ELSE entry[s] END) * (1 - stop / 100) AS stop_at,
                              CASE WHEN q[s] = 0 THEN NULL WHEN NOT target_trails THEN entry[s] * (1 + target / 100)
                                WHEN (trail[s] IS NULL AND entry[s] * (1 + target / 100) <= high) OR trail[s] < high THEN high * (1 - target / 100) ELSE trail[s] END AS trails
                            FROM (SELECT b.*, cash, q, spent, entry, peak, trail, entries, outs, wait, acted, greatest(0, wait[b.s] - 1) AS left_to_wait, CASE WHEN q[b.s] > 0 THEN greatest(peak[b.s], high) ELSE peak[b.s] END AS top
                              FROM st JOIN b ON b.j = st.j + 1) a0) a1) a2) a3) a4) a5) a6) a7) a8) a9) a10) a11),
    tail AS (SELECT * FROM st WHERE j = (SELECT max(j) FROM st)), closing AS (SELECT b.datetime, b.symbol, b.s, tail.q[b.s] AS quantity, tail.spent[b.s] AS gone, b.close * (1 - b.slip) AS price, b.fee_rate FROM tail JOIN b ON b.datetime = tail.datetime WHERE tail.q[b.s] > 0),
    rows AS (
      SELECT 'trade' AS kind, datetime, symbol, side, price, quantity, fee, pnl, reason, NULL::DOUBLE AS cash, NULL::DOUBLE AS position_value, NULL::DOUBLE AS total_equity FROM st WHERE side IS NOT NULL
      UNION ALL SELECT 'equity', datetime, NULL, NULL, NULL, NULL, NULL, NULL, NULL, cash, held, cash + held FROM st WHERE s = {m}
      UNION ALL SELECT 'trade', datetime, symbol, 'SELL', price, quantity, quantity * price * fee_rate, quantity * price - quantity * price * fee_rate - gone, 'final_close', NULL, NULL, NULL FROM closing)"""


def single(signals: str, stops: dict, trailing: tuple[str, ...], targets: dict, sizes: dict, fee: dict, slip: dict, cooled: str) -> str:
    """The single-symbol simulator, one run for each symbol, all runs at once; ends with `rows`."""
    of = lambda values, default: "CASE symbol " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"
    return f"""{signals}, b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS k, count(*) OVER (PARTITION BY symbol) AS n, ({of(stops, "NULL")})::DOUBLE AS stop, symbol IN ({", ".join(f"'{x}'" for x in trailing)}) AS trails,
      ({of(targets, "NULL")})::DOUBLE AS target, ({of(sizes, 100.0)})::DOUBLE AS size, ({of(fee, 0.0)})::DOUBLE / 100 AS fee_rate, ({of(slip, 0.0)})::DOUBLE / 100 AS slip, symbol = '{cooled}' AS cools FROM sig),
    st AS (
      SELECT symbol, 0::BIGINT AS k, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS held, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS peak, NULL::BIGINT AS acted, NULL::TIMESTAMP AS datetime, NULL::DOUBLE AS close, NULL::BOOLEAN AS listed,
        NULL::DOUBLE AS out_price, NULL::DOUBLE AS out_quantity, NULL::DOUBLE AS out_fee, NULL::DOUBLE AS out_pnl, NULL::VARCHAR AS out_reason, NULL::DOUBLE AS in_price, NULL::DOUBLE AS in_quantity, NULL::DOUBLE AS in_fee FROM b WHERE k = 1
      UNION ALL
      SELECT symbol, k, CASE WHEN enters THEN after - amount - in_fee ELSE after END, CASE WHEN enters THEN amount / in_price WHEN way_out IS NOT NULL THEN 0.0 ELSE held END, CASE WHEN enters THEN in_price ELSE entry END, CASE WHEN enters THEN high ELSE top END,
        CASE WHEN enters THEN k ELSE acted END, datetime, close, NOT (free AND blocked), CASE WHEN way_out IS NOT NULL THEN fill END, CASE WHEN way_out IS NOT NULL THEN held END, CASE WHEN way_out IS NOT NULL THEN paid END, CASE WHEN way_out IS NOT NULL THEN (fill - entry) * held - paid END,
        CASE WHEN way_out IS NOT NULL THEN why END, CASE WHEN enters THEN in_price END, CASE WHEN enters THEN amount / in_price END, CASE WHEN enters THEN in_fee END
      FROM (SELECT *, free AND NOT blocked AND buy AND amount > 0 AND after >= amount + in_fee AS enters
        FROM (SELECT *, amount * fee_rate AS in_fee, close * (1 + slip) AS in_price
          FROM (SELECT *, after * size / 100 AS amount, cools AND acted IS NOT NULL AND k - acted < 4 AS blocked, held = 0 OR way_out IS NOT NULL AS free
            FROM (SELECT *, CASE WHEN way_out IS NOT NULL THEN cash + (held * fill - paid) ELSE cash END AS after
              FROM (SELECT *, held * fill * fee_rate AS paid
                FROM (SELECT *, way_out * (1 - slip) AS fill
                  FROM (SELECT *, CASE WHEN held = 0 THEN NULL WHEN stops THEN stop_at WHEN takes THEN close WHEN sell THEN close END AS way_out, CASE WHEN stops THEN 'stop_loss' WHEN takes THEN 'take_profit' ELSE 'sell_signal' END AS why
                    FROM (SELECT *, coalesce(held > 0 AND (close <= stop_at OR (low <= stop_at AND stop_at <= high)), false) AS stops, coalesce(held > 0 AND close >= entry * (1 + target / 100), false) AS takes
                      FROM (SELECT *, (CASE WHEN trails THEN top ELSE entry END) * (1 - stop / 100) AS stop_at
                        FROM (SELECT b.*, cash, held, entry, acted, CASE WHEN held > 0 THEN greatest(peak, high) ELSE peak END AS top FROM st JOIN b ON b.symbol = st.symbol AND b.k = st.k + 1) a0) a1) a2) a3) a4) a5) a6) a7) a8) a9),
    closing AS (SELECT b.symbol, b.datetime, b.close * (1 - slip) AS price, held, entry, fee_rate FROM st JOIN b ON b.symbol = st.symbol AND b.k = st.k AND b.k = b.n WHERE held > 0),
    rows AS (
      SELECT symbol AS run_id, 'trade' AS kind, datetime, symbol, 'SELL' AS side, out_price AS price, out_quantity AS quantity, out_fee AS fee, out_pnl AS pnl, out_reason AS reason, NULL::DOUBLE AS cash, NULL::DOUBLE AS position_value, NULL::DOUBLE AS total_equity FROM st WHERE out_reason IS NOT NULL
      UNION ALL SELECT symbol, 'trade', datetime, symbol, 'BUY', in_price, in_quantity, in_fee, -in_fee, 'buy_signal', NULL, NULL, NULL FROM st WHERE in_price IS NOT NULL
      UNION ALL SELECT symbol, 'equity', datetime, NULL, NULL, NULL, NULL, NULL, NULL, NULL, cash, held * close, cash + held * close FROM st WHERE listed
      UNION ALL SELECT symbol, 'trade', datetime, symbol, 'SELL', price, held, held * price * fee_rate, (price - entry) * held - held * price * fee_rate, 'final_close', NULL, NULL, NULL FROM closing)"""


def orders(signals: str, names: tuple[str, ...]) -> str:
    """The order simulator of one run over all symbols, one step for each time; ends with `rows`. Default
    statutory costs."""
    m = len(names)
    every = lambda x: f"[{x} FOR i IN range(1, {m + 1})]"
    number = "CASE symbol " + " ".join(f"WHEN '{n}' THEN {k + 1}" for k, n in enumerate(names)) + " END"
    bar = ", ".join(f"max(struct_pack(open := open, close := close, buy := buy, sell := sell)) FILTER (WHERE s = {k + 1})" for k in range(m))
    zero, none = ", ".join(["0.0::DOUBLE"] * m), ", ".join(["NULL::DOUBLE"] * m)
    fee = "(t[i] * CASE WHEN side[i] = 'SELL' THEN 0.1 ELSE 0.015 END / 100 + t[i] * 0.00325 / 100 + t[i] * 10.0 / 1e7 + t[i] * 0.00325 / 100 * 18.0 / 100)"
    return f"""{signals}, numbered AS (SELECT *, {number} AS s, dense_rank() OVER (ORDER BY datetime) AS k FROM sig), b AS MATERIALIZED (SELECT k, datetime, [{bar}] AS bars FROM numbered GROUP BY 1, 2),
    st AS (
      SELECT 0::BIGINT AS k, NULL::TIMESTAMP AS datetime, 100000.0::DOUBLE AS cash, [{zero}] AS held, [{zero}] AS paid, [{zero}] AS last, [{none}] AS wanted, [{none}] AS fill, [{none}] AS amount, [{none}] AS fees, [{none}] AS pnl
      UNION ALL
      SELECT k, datetime, after, new_held, new_paid, {every("coalesce(bars[i].close, last[i])")},
        {every("CASE WHEN bars[i] IS NULL THEN wanted[i] WHEN bars[i].buy AND new_held[i] = 0 THEN CASE WHEN bars[i].close > 0 AND after > 0 THEN after / bars[i].close END WHEN bars[i].sell AND new_held[i] > 0 THEN -new_held[i] END")},
        price, amount, fees, {every("CASE WHEN side[i] = 'SELL' THEN amount[i] * (price[i] - paid[i]) WHEN side[i] = 'BUY' THEN 0.0 END")}
      FROM (SELECT *, cash + list_sum({every("CASE side[i] WHEN 'BUY' THEN -(price[i] * amount[i] + fees[i]) WHEN 'SELL' THEN price[i] * amount[i] - fees[i] ELSE 0.0 END")}) AS after,
          {every("CASE side[i] WHEN 'BUY' THEN held[i] + amount[i] WHEN 'SELL' THEN held[i] - amount[i] ELSE held[i] END")} AS new_held,
          {every("CASE WHEN side[i] = 'BUY' THEN (held[i] * paid[i] + amount[i] * price[i]) / (held[i] + amount[i]) ELSE paid[i] END")} AS new_paid
        FROM (SELECT *, {every(f"CASE WHEN side[i] IS NOT NULL THEN {fee} END")} AS fees, {every("CASE side[i] WHEN 'BUY' THEN wanted[i] WHEN 'SELL' THEN least(-wanted[i], held[i]) END")} AS amount
          FROM (SELECT *, {every("price[i] * abs(wanted[i])")} AS t
            FROM (SELECT *, {every("CASE side[i] WHEN 'BUY' THEN bars[i].open * (1 + 0.05 / 100) WHEN 'SELL' THEN bars[i].open * (1 - 0.05 / 100) END")} AS price
              FROM (SELECT b.k, b.datetime, b.bars, cash, held, paid, last, wanted, {every("CASE WHEN b.bars[i] IS NULL THEN NULL WHEN wanted[i] > 0 THEN 'BUY' WHEN wanted[i] < 0 THEN 'SELL' END")} AS side FROM st JOIN b ON b.k = st.k + 1) a0) a1) a2) a3) a4),
    rows AS (
      SELECT 'equity' AS kind, datetime, NULL::VARCHAR AS symbol, NULL::VARCHAR AS side, NULL::DOUBLE AS price, NULL::DOUBLE AS quantity, NULL::DOUBLE AS fee, NULL::DOUBLE AS pnl, NULL::VARCHAR AS reason, cash, list_sum({every("held[i] * last[i]")}) AS position_value, cash + list_sum({every("held[i] * last[i]")}) AS total_equity FROM st WHERE k > 0
      UNION ALL SELECT 'trade', datetime, [{", ".join(f"'{n}'" for n in names)}][i], CASE WHEN sold THEN 'SELL' ELSE 'BUY' END, fill[i], amount[i], fees[i], pnl[i], 'market_fill', NULL, NULL, NULL
        FROM (SELECT st.*, i, lag(wanted[i]) OVER (PARTITION BY i ORDER BY k) < 0 AS sold FROM st, range(1, {m + 1}) r(i)) x WHERE fill[i] IS NOT NULL)"""


def paper(events: str) -> str:
    """Paper trading of all accounts: CTEs of `events` (account, seq, kind, order_id, symbol, side, order_type,
    quantity, price). When an order would fill depends on prices alone; a recursion over placements and fills then
    tells which sells were covered. Ends with `rows`, without the columns of the order. Default statutory costs."""
    t = "q * fill"
    fee = f"({t} * CASE WHEN side = 'SELL' THEN 0.1 ELSE 0.015 END / 100 + {t} * 0.00325 / 100 + {t} * 10.0 / 1e7 + {t} * 0.00325 / 100 * 18.0 / 100)"
    put = lambda column, new: f"[CASE WHEN i = s AND acts THEN {new} ELSE {column}[i] END FOR i IN range(1, len({column}) + 1)]"
    return f"""e AS MATERIALIZED ({events}), o AS (SELECT *, dense_rank() OVER (ORDER BY symbol) AS s FROM e WHERE kind = 'order'),
    would AS (SELECT o.account, o.order_id, min(p.seq) AS fill_seq, arg_min(p.price, p.seq) AS touched FROM o JOIN e p ON p.kind = 'price' AND p.account = o.account AND p.symbol = o.symbol AND p.seq > o.seq
      AND (o.order_type = 'MARKET' OR CASE WHEN o.side = 'BUY' THEN p.price <= o.price ELSE p.price >= o.price END) GROUP BY 1, 2),
    gone AS (SELECT o.account, o.order_id, min(c.seq) AS cancel_seq FROM o JOIN e c ON c.kind = 'cancel' AND c.account = o.account AND c.order_id = o.order_id AND c.seq > o.seq GROUP BY 1, 2),
    x AS (SELECT o.*, CASE WHEN cancel_seq IS NULL OR fill_seq < cancel_seq THEN fill_seq END AS fill_seq, cancel_seq, CASE WHEN order_type = 'MARKET' THEN touched ELSE price END AS raw FROM o LEFT JOIN would USING (account, order_id) LEFT JOIN gone USING (account, order_id)),
    acts AS (SELECT account, order_id, seq AS happens, 0 AS phase, seq, s, side, quantity AS q, 0.0::DOUBLE AS fill FROM x UNION ALL
      SELECT account, order_id, fill_seq, 1, seq, s, side, quantity, raw * CASE WHEN side = 'BUY' THEN 1 + 0.05 / 100 ELSE 1 - 0.05 / 100 END FROM x WHERE fill_seq IS NOT NULL),
    b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account ORDER BY happens, phase, seq) AS k FROM acts),
    st AS (
      SELECT account, 0::BIGINT AS k, [0.0::DOUBLE FOR i IN range(0, (SELECT max(s) FROM o))] AS held, [0.0::DOUBLE FOR i IN range(0, (SELECT max(s) FROM o))] AS paid, []::VARCHAR[] AS refused, NULL::VARCHAR AS order_id, 0 AS phase, NULL::BOOLEAN AS acts, NULL::DOUBLE AS realized, NULL::DOUBLE AS fee, NULL::DOUBLE AS fill FROM b WHERE k = 1
      UNION ALL
      SELECT account, k, {put("held", "CASE WHEN side = 'BUY' THEN held[i] + q ELSE held[i] - least(q, held[i]) END")}, {put("paid", "CASE WHEN side = 'BUY' THEN (held[i] * paid[i] + q * fill) / (held[i] + q) WHEN held[i] > q THEN paid[i] ELSE 0.0 END")},
        CASE WHEN phase = 0 AND side = 'SELL' AND q > held[s] THEN list_append(refused, order_id) WHEN phase = 1 THEN [r FOR r IN refused IF r <> order_id] ELSE refused END, order_id, phase, CASE WHEN phase = 0 THEN side = 'BUY' OR q <= held[s] ELSE acts END,
        CASE WHEN side = 'SELL' THEN least(q, held[s]) * (fill - paid[s]) ELSE 0.0 END, {fee}, fill
      FROM (SELECT b.*, held, paid, refused, b.phase = 1 AND NOT list_contains(refused, b.order_id) AS acts FROM st JOIN b ON b.account = st.account AND b.k = st.k + 1) a),
    placed AS (SELECT account, order_id, acts FROM st WHERE k > 0 AND phase = 0), filled AS (SELECT account, order_id, realized, fee, fill FROM st WHERE k > 0 AND phase = 1 AND acts),
    rows AS (SELECT x.*, CASE WHEN NOT acts THEN 'REJECTED' WHEN filled.fill IS NOT NULL THEN 'COMPLETE' WHEN cancel_seq IS NOT NULL THEN 'CANCELLED' ELSE 'OPEN' END AS status, CASE WHEN NOT acts THEN 'long-only: sells more than held' END AS message,
      CASE WHEN filled.fill IS NOT NULL THEN x.fill_seq END AS filled_at, filled.fill, filled.fee, filled.realized FROM x JOIN placed USING (account, order_id) LEFT JOIN filled USING (account, order_id))"""
