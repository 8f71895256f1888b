"""Wallets that run dry, chunk by chunk, against the rules applied one by one."""

import random

import pytest

from karvan.operators import billing

SCHEMA = "seller_key string, event_id long, occurred_us long, prio int, kind string, amount_toman long"


def _one_by_one(rows):
    out, state = [], {}
    for seller, event, us, _, kind, amount in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
        balance, active = state.get(seller, (0, True))
        before, applied, reason = active, 0, None
        if kind == "topup":
            applied, active = amount, True
        elif kind == "manual" and balance + amount < 0:
            reason = "would_go_negative"
        elif kind == "manual":
            applied = amount
            if balance + amount == 0:
                active, reason = False, "zero_balance"
            elif amount > 0:
                active = True
        elif active and balance + amount >= 0:
            applied = amount
            if balance + amount == 0:
                active, reason = False, "zero_balance"
        elif active:
            active, reason = False, "insufficient_balance"
        balance += applied
        state[seller] = (balance, active)
        out.append((seller, event, us, kind, applied, balance, active, before != active, reason))
    return out


def _events(seller, n, seed, dry=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choices(("charge", "topup", "manual"), (20, 3 if dry else 30, 2))[0]
        amount = {"charge": -rng.choice((0, 100, 100, 250, 70)), "topup": rng.choice((0, 100, 500, 730)), "manual": rng.choice((-300, 0, 40, 100))}[kind]
        rows.append((seller, i, rng.randint(0, 5) * 86_400_000_000 + i // 3, {"topup": 0, "manual": 1, "charge": 2}[kind], kind, amount))
    return rows


@pytest.mark.parametrize("seed", range(30))
def test_a_run_of_events_is_one_function(seed):
    rng = random.Random(seed)
    rows = sorted(_events("s", 40, seed), key=lambda r: (r[2], r[3], r[1]))
    fn = billing.BalanceFunction()
    for r in rows:
        fn.then(r[4], r[5])
    for balance in [0, 1, *(rng.randint(0, 4000) for _ in range(200)), 10**9]:
        for active in (True, False):
            head = [("s", -2, -2, 0, "topup", balance)]
            if not active:  # a charge that cannot be paid closes the wallet
                head.append(("s", -1, -1, 2, "charge", -balance - 1))
            want = _one_by_one(head + rows)[-1]
            at = [i for i in range(len(fn.lo)) if fn.entry[i] == active and fn.lo[i] <= balance < fn.hi[i]]
            assert len(at) == 1
            assert (balance + fn.shift[at[0]], bool(fn.active[at[0]])) == (want[5], want[6])


@pytest.mark.parametrize(("hot", "chunk"), [(10**9, 256), (10**9, 7), (50, 16)])
def test_half_of_all_rows_in_one_dry_wallet(spark, hot, chunk):
    rows = _events("hot", 900, 1)
    for i in range(30):
        rows += _events(f"s{i}", 30, i + 2, dry=i % 2 == 0)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = billing.wallet_charge(frame, hot, chunk).collect()
    key = lambda r: (r[0], r[1])
    assert sorted([tuple(r) for r in got], key=key) == sorted(_one_by_one(rows), key=key)
