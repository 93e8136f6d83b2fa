from __future__ import annotations

import json

import pytest

from scholia.functions.passwords import Pbkdf2Hasher
from scholia.plans.routes import ROUTES, Service
from scholia.sources.fixtures import load
from scholia.sources.schemas import TABLES

NOW = "2024-06-01 12:00:00"


@pytest.fixture(scope="module")
def service(spark, sf_dir):
    return Service(spark, {t: load(spark, sf_dir, t).cache() for t in TABLES}, NOW, Pbkdf2Hasher(rounds=10))


def test_there_are_64():
    assert len({(r.method, r.path) for r in ROUTES}) == len(ROUTES) == 64


@pytest.mark.parametrize(
    ("method", "path", "status", "wire"),
    [
        ("GET", "/api/v1/accounts/1", 200, 200),
        ("GET", "/api/v1/accounts/7", 404, 500),
        ("GET", "/api/v1/accounts/trash", 200, 200),
        ("GET", "/api/v1/accounts/username/Customer#000000001", 200, 200),
        ("GET", "/api/v1/accounts/username/nobody", 404, 500),
        ("GET", "/api/v1/accounts/1/roles", 200, 200),
        ("GET", "/api/v1/accounts/7/roles", 404, 500),
        ("GET", "/api/v1/users/2/with-account", 200, 200),
        ("GET", "/api/v1/users/account/999999", 200, 200),
        ("DELETE", "/api/v1/roles/1", 204, 204),
        ("DELETE", "/api/v1/roles/6", 404, 500),
        ("POST", "/api/v1/roles/1/restore", 400, 500),
        ("POST", "/api/v1/roles/6/restore", 204, 204),
        ("DELETE", "/api/v1/roles/1/purge", 400, 500),
        ("DELETE", "/api/v1/accounts/7/purge", 500, 500),
        ("DELETE", "/api/v1/terms/3/purge", 204, 204),
        ("POST", "/api/v1/accounts/7/login", 404, 500),
        ("POST", "/api/v1/accounts/1/roles/6", 404, 500),
        ("DELETE", "/api/v1/accounts/1/roles/24", 404, 500),
        ("PATCH", "/api/v1/roles/1", 404, 404),
    ],
)
def test_statuses(service, method, path, status, wire):
    got = service.answer(method, path)
    assert (got.status, got.wire_status) == (status, wire)


def test_active_flag_is_true_unless_given(service):
    yes, no = (service.answer("GET", "/api/v1/accounts/active", q).rows for q in ({}, {"active": "false"}))
    assert {r["active"] for r in yes.collect()} == {True} and {r["active"] for r in no.collect()} == {False}


def test_creating_and_reading_back(service):
    got = service.answer("POST", "/api/v1/courses", body=json.dumps({"code": " new-1", "name": "A course"}))
    row = got.rows.collect()[0]
    assert (got.status, got.location, row["code"]) == (201, f"/api/v1/courses/{row['id']}", "NEW-1")
    again = Service(service.spark, {**service.tables, **got.changed}, NOW).answer("GET", got.location)
    assert again.rows.collect()[0]["name"] == "A course"
    assert service.answer("POST", "/api/v1/courses", body=json.dumps({"code": "c1", "name": "Taken"})).status == 409
    assert service.answer("POST", "/api/v1/courses", body="no json").status == 400
    assert (lambda a: (a.status, a.location))(service.answer("POST", "/api/v1/terms", body=json.dumps({"name": "x", "number": 9}))) == (200, None)


def test_passwords(service):
    got = service.answer("POST", "/api/v1/accounts", body=json.dumps({"username": "somebody", "email": "Some@Body.example", "password": "secret-pass"}))
    assert got.status == 201 and "password_hash" not in got.rows.columns
    after = Service(service.spark, {**service.tables, **got.changed}, NOW, service.hasher)
    assert after.verify_password(" somebody", "secret-pass") and not after.verify_password("somebody", "other") and not after.verify_password("nobody", "x")


def test_updating_and_roles(service):
    got = service.answer("PUT", "/api/v1/roles/1", body=json.dumps({"name": "renamed", "description": None}))
    assert got.status == 200 and got.rows.collect()[0]["name"] == "RENAMED"
    assert service.answer("PUT", "/api/v1/roles/6", body=json.dumps({"name": "renamed"})).status == 404
    accounts = service.tables["accounts"].where("deleted_at IS NULL").selectExpr("id AS account_id")
    account = service.tables["account_roles"].where("deleted_at IS NULL AND role_id % 6 > 0").join(accounts, "account_id", "left_semi").first()
    path = f"/api/v1/accounts/{account['account_id']}/roles/{account['role_id']}"
    assert service.answer("POST", path).status == 409
    removed = service.answer("DELETE", path)
    assert removed.status == 204
    assert Service(service.spark, {**service.tables, **removed.changed}, NOW).answer("POST", path).status == 204
