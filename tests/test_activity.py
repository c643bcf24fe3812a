import hashlib
from datetime import date

import pytest

from tenure.plans.accounts import user_features, user_flags
from tenure.plans.activity import (
    action_features, update_growth, update_recency, update_summary, weekly_update_features,
    wide_update_features,
)
from tenure.plans.flags import derive_flags
from tenure.plans.support import support_email_features

ACTIONS = "id string, user_id string, full_scope string, created_at timestamp_ntz"
UPDATES = (
    "id string, user_id string, profile_id string, created_at timestamp_ntz, client_type string, "
    "was_sent_with_product boolean"
)
ERRORS = "id string, update_id string"
BILLING = "dashboard settings billing viewed"


@pytest.fixture
def users(rows):
    return rows("user_id string", [("a",), ("a",), ("b",)])


def up(key, ts, user="a", profile="p", client="web", sent=True):
    return (key, user, profile, ts, client, sent)


@pytest.mark.parametrize("t", ["2018-04-01 12:00:00", "2018-03-26 12:00:00", "2018-03-28 12:00:00"])
def test_actions_last_week_for_every_weekday_of_t(rows, users, t):
    df = rows(
        ACTIONS,
        [("1", "a", "x", "2018-03-19 00:00:00"), ("2", "a", "x", "2018-03-25 23:59:59"),
         ("3", "a", "x", "2018-03-18 23:59:59"), ("4", "a", "x", "2018-03-26 00:00:00")],
    )
    assert action_features(df, users, t).first()["actions_last_week"] == 2


def test_action_counts_prefix_and_exact(rows, users):
    df = rows(
        ACTIONS,
        [
            ("1", "a", BILLING, "2018-03-20"), ("1", "a", BILLING, "2018-03-20"),
            ("2", "a", "dashboard settings billing updated", "2018-03-13"),
            ("3", "a", "dashboard analytics posts viewed", "2018-03-20"),
            ("4", "a", None, "2018-03-20"), (None, "a", BILLING, "2018-02-27"),
            ("5", "b", "other", "2018-03-20"), ("6", "c", BILLING, "2018-03-20"),
            ("7", "a", BILLING, "2018-02-03 23:59:59"),
        ],
    )
    found = {r["user_id"]: r for r in action_features(df, users, "2018-04-01").collect()}
    assert set(found) == {"a", "b"}
    a = found["a"]
    assert (a["billing_actions"], a["analytics_actions"], a["number_of_weeks_with_actions"]) == (2, 1, 3)
    assert found["b"]["billing_actions"] == 0
    exact = action_features(df, users, "2018-04-01", match="exact", last_week=False)
    a = {r["user_id"]: r for r in exact.collect()}["a"]
    assert (a["billing_actions"], a["number_of_weeks_with_actions"]) == (1, 2)
    assert "actions_last_week" not in exact.columns


def test_weekly_updates_do_not_fan_out(rows, users):
    updates = rows(
        UPDATES,
        [up("1", "2018-03-19 01:00:00", client="Extension"), up("2", "2018-03-19 05:00:00"),
         up("3", "2018-03-20 05:00:00"), up("3", "2018-03-20 05:00:00"), up("4", "2018-03-12 05:00:00")],
    )
    errors = rows(ERRORS, [("e1", "1"), ("e2", "1"), ("e2", "1"), ("e3", "9")])
    weekly = weekly_update_features(updates, errors, users, "2018-04-01")
    found = {r["week"]: r for r in weekly.collect()}
    row = found[date(2018, 3, 19)]
    assert (row["number_of_updates"], row["number_of_days_with_updates"]) == (3, 2)
    assert (row["number_of_extension_updates"], row["number_of_update_errors"]) == (1, 2)
    assert row["number_of_weeks_with_updates"] == 1
    assert found[date(2018, 3, 12)]["number_of_update_errors"] == 0
    wide = wide_update_features(weekly, "2018-04-01").collect()
    assert len(wide) == 1
    assert wide[0]["number_of_updates_week_6"] == 3
    assert wide[0]["number_of_updates_week_m1"] == 0
    assert len(wide[0]) == 1 + 4 * 9
    trimmed = wide_update_features(weekly, "2018-04-01", drop_partial=True)
    assert "number_of_updates_week_m1" not in trimmed.columns and len(trimmed.columns) == 1 + 4 * 8


def test_weekly_updates_through_profiles(rows, users):
    updates = rows(
        UPDATES,
        [up("1", "2018-03-19", user="z", profile="p1"), up("2", "2018-03-19", user="z", profile="p2"),
         up("3", "2018-03-19", user="z", profile="p2", sent=False), up("4", "2018-03-19", profile="p9")],
    )
    profiles = rows("id string, user_id string", [("p1", "a"), ("p2", "a"), ("p2", "a"), ("p9", "q")])
    weekly = weekly_update_features(
        updates, rows(ERRORS, [("e", "2")]), users, "2018-04-01", sent_only=True, profiles=profiles
    ).collect()
    assert len(weekly) == 1
    row = weekly[0]
    assert (row["user_id"], row["number_of_updates"], row["number_of_profiles"]) == ("a", 2, 2)
    assert row["number_of_update_errors"] == 1


def test_summary_drops_edge_weeks_everywhere(rows):
    users = rows("user_id string", [("edge",), ("one",), ("two",)])
    updates = rows(
        UPDATES,
        [
            up("1", "2018-03-05", user="edge"), up("2", "2018-03-26", user="edge"),
            up("3", "2018-03-12", user="one"), up("4", "2018-03-13", user="one"),
            up("5", "2018-03-12", user="two"), up("6", "2018-03-19", user="two"),
            up("7", "2018-03-20", user="two"), up("8", "2018-03-21", user="two", sent=False),
        ],
    )
    out = {r["user_id"]: r for r in update_summary(updates, users, "2018-04-01").collect()}
    assert set(out) == {"one", "two"}
    assert tuple(out["one"])[1:] == (1, 2, 0)
    assert tuple(out["two"])[1:] == (2, 3, 2)
    growth = {r["user_id"]: r for r in update_growth(updates, users, "2018-04-01").collect()}
    # weeks 2018-03-12 and 2018-03-19: (2, 0) and (1, 2) over 7/365 of a year
    assert growth["one"]["estimate"] == pytest.approx(-2 * 365 / 7)
    assert growth["two"]["estimate"] == pytest.approx(1 * 365 / 7)
    assert growth["two"]["updates_per_week"] == pytest.approx(1.5)


def test_one_interior_week_has_no_slope(rows):
    users = rows("user_id string", [("a",)])
    updates = rows(UPDATES, [up("1", "2018-03-05"), up("2", "2018-03-12"), up("3", "2018-03-19")])
    row = update_growth(updates, users, "2018-04-01").first()
    assert row["estimate"] is None and row["total_updates"] == 1


def test_recency_and_idle(rows):
    ages = {"today": "2018-04-01 00:00:00", "six": "2018-03-26 09:00:00", "seven": "2018-03-25",
            "ninety": "2018-01-01", "old": "2017-12-31"}
    users = rows("user_id string", [(k,) for k in [*ages, "never"]])
    updates = rows(UPDATES, [up(k, ts, user=k) for k, ts in ages.items()] + [up("x", "2018-04-01 00:00:01", user="old")])
    days = update_recency(updates, users, "2018-04-01")
    out = derive_flags(users.join(days, "user_id", "left"), "2018-04-01")
    found = {r["user_id"]: (r["days_since_last_update"], r["is_idle"], r["updates_past_week"]) for r in out.collect()}
    assert found == {
        "today": (0, False, True), "six": (6, False, True), "seven": (7, False, False),
        "ninety": (90, False, False), "old": (91, True, False), "never": (None, True, False),
    }


def test_user_features_do_not_multiply(rows, spark):
    cohort = rows("user_id string", [("a",), ("a",)])
    names = ["locale_browser_language string", "is_suspended boolean", "is_approved boolean",
             "has_notifications_enabled boolean", "has_verified_email boolean", "timezone string",
             "twofactor_type string", "number_of_bonus_profiles long", "number_of_bonus_team_members long",
             "number_of_default_profiles long", "number_of_password_resets long"]
    accounts = rows("id string, created_at timestamp_ntz, " + ", ".join(names),
                    [("a", "2017-01-01", "en", *[None] * 10), ("b", "2017-01-01", "en", *[None] * 10)])
    assert user_features(accounts, cohort).count() == 1


def test_user_flags_under_missing_facts(rows):
    accounts = rows("id string, billing_stripe_customer_id string, created_at timestamp_ntz",
                    [(k, "c", "2017-01-01 08:00:00") for k in "abcd"])
    team = rows("user_id string, number_of_team_members long", [("a", 1), ("b", 0), ("c", None)])
    clients = rows("user_id string, is_ios_user boolean, is_android_user boolean",
                   [("a", False, True), ("b", False, None), ("c", None, True)])
    out = user_flags(accounts, team, clients, accounts.selectExpr("id as user_id"))
    assert {r["user_id"]: (r["has_team_member"], r["is_mobile_user"]) for r in out.collect()} == {
        "a": (True, True), "b": (False, False), "c": (False, True), "d": (False, False),
    }
    assert out.first()["signup_date"] == date(2017, 1, 1)


def test_support_emails(rows):
    def conv(key, customer='{"email":"x@y"}', creator='{"type":"customer"}', box='{"name":"Support"}',
             ts="2018-03-20", kind="email", draft=False):
        return (key, ts, kind, draft, customer, creator, box)

    df = rows(
        "id long, createdat timestamp_ntz, type string, isdraft boolean, customer string, createdby string, mailbox string",
        [
            conv(1), conv(1), conv(2, box="{}"), conv(3, box=None), conv(4, box="not json"),
            conv(5, box='{"name":"Tracking emails"}'), conv(6, box='{"name":"Join Us"}'),
            conv(7, box='{"name":"The Next Thing"}'), conv(8, customer='{"email":""}'),
            conv(9, customer=None), conv(10, creator='{"type":"user"}'), conv(11, creator="{}"),
            conv(12, kind="phone"), conv(13, draft=True), conv(14, ts="2018-02-03"), conv(15, draft=None),
        ],
    )
    found = {r[0]: r[1] for r in support_email_features(df, "2018-04-01").collect()}
    assert found == {hashlib.sha1(b"x@y").hexdigest(): 4, None: 2}
