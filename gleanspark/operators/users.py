"""User table mutations over batches of requests."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.access import (
    ACTOR_INACTIVE,
    ACTOR_NOT_FOUND,
    BAD_REQUEST,
    CONFLICT,
    FORBIDDEN,
    NO_PERMISSION_GATE,
    NOT_FOUND,
    OK,
    SERVER_ERROR,
    USER_NOT_FOUND,
    actors,
    gate_outcome,
    gate_reason,
)
from gleanspark.operators.integrity import USER_DEFAULTS, apply_defaults, row_id
from gleanspark.operators.patching import Patched, apply_patches, null_fault
from gleanspark.plans.durable import settle, written
from gleanspark.plans.ordered import by_components, one_pass, pass_limit
from gleanspark.plans.skew import keys_present, lookup_join, shuffle_join
from gleanspark.sources.schemas import USER_COLUMNS

# Messages of refused requests.
EMAIL_EXISTS_ON_CREATE = "该邮箱对应的用户已在系统中存在。"
EMAIL_EXISTS_ON_UPDATE = "该邮箱的用户已存在"
ID_NOT_FOUND = "该用户ID在系统中不存在"
NO_SELF_DELETE = "超级用户不允许自行删除。"
OWNS_TASKS = "user still owns tasks"

ADMIN_FIELDS = ("email", "is_active", "is_superuser", "full_name", "hashed_password")
SELF_FIELDS = ("full_name", "email")
_NOT_NULL = ("email", "is_active", "is_superuser", "hashed_password")


class UserAdmission(NamedTuple):
    """New user rows and one outcome per request."""

    accepted: DataFrame
    outcomes: DataFrame


def admit_users(requests: DataFrame, users: DataFrame, now: Column | None = None) -> UserAdmission:
    """Create users whose email is new, the first request per email winning.

    A request has ``seq``, ``email``, ``hashed_password`` (ready-made) and optional columns,
    which default. With an ``actor_id`` the actor must be known (404), active (400) and a
    superuser (403); a request refused for that claims nothing. Emails are reduced to their first
    request before they meet the user table.
    """
    columns = ["seq", "email"]
    gated = requests.select(*columns).withColumns({"refused": F.lit(None).cast("int"), "why": F.lit(None).cast("string")})
    if "actor_id" in requests.columns:
        seen = lookup_join(requests.select("actor_id", *columns), actors(users, "actor_id"), "actor_id")
        gated = settle(seen.select(*columns, _superuser_outcome().alias("refused"), _superuser_reason().alias("why")))
    first = gated.where("refused IS NULL").groupBy("email").agg(F.min("seq").alias("seq"))
    taken = keys_present(first, users, "email")
    new = lookup_join(first, taken, "email", "left_anti", unique=True)
    new = settle(new.select("seq").withColumn("is_new", F.lit(True)))
    outcomes = (
        lookup_join(gated, new, "seq", unique=True)
        .withColumn("outcome", F.coalesce("refused", F.when(F.col("is_new"), F.lit(OK)).otherwise(F.lit(BAD_REQUEST))))
        .withColumn("reason", F.coalesce("why", F.when(F.col("is_new").isNull(), F.lit(EMAIL_EXISTS_ON_CREATE))))
        .select("seq", "email", "outcome", "reason")
    )
    rows = lookup_join(requests, new.select("seq"), "seq", "left_semi", unique=True)
    rows = apply_defaults(rows, USER_DEFAULTS, ("created_at",), now)
    if "id" not in rows.columns:
        rows = rows.withColumn("id", row_id("email", "seq"))
    return UserAdmission(rows.select(*USER_COLUMNS), outcomes)


def _superuser_outcome() -> Column:
    no_right = ~F.coalesce("actor_is_superuser", F.lit(False))
    return F.when(gate_outcome().isNotNull(), gate_outcome()).when(no_right, F.lit(FORBIDDEN))


def _superuser_reason() -> Column:
    no_right = ~F.coalesce("actor_is_superuser", F.lit(False))
    return F.when(gate_reason().isNotNull(), gate_reason()).when(no_right, F.lit(NO_PERMISSION_GATE))


def _delete_rounds(open_requests: DataFrame) -> DataFrame:
    """Of requests the state allows (``seq, actor_id, user_id``), those that a one-by-one pass
    carries out.

    A request is carried out for certain if it is the first against its user and no earlier one
    is against its actor. Later requests against that user, or by it, then fail for certain. A
    round settles all of these at once; rounds repeat to the end, as many as the longest chain
    of requests that depend on each other.
    """
    columns = open_requests.columns
    done: list[DataFrame] = []
    while True:
        first = open_requests.groupBy("user_id").agg(F.min("seq").alias("first"))
        against_actor = first.select(F.col("user_id").alias("actor_id"), F.col("first").alias("against_actor"))
        certain = (
            open_requests.join(first.withColumnRenamed("first", "seq"), ["user_id", "seq"], "left_semi")
            .join(against_actor, "actor_id", "left")
            .where("against_actor IS NULL OR against_actor > seq")
            .select("user_id", F.col("seq").alias("gone_at"))
        )
        by_actor = certain.select(F.col("user_id").alias("actor_id"), F.col("gone_at").alias("actor_gone_at"))
        marked = written(
            open_requests.join(certain, "user_id", "left").join(by_actor, "actor_id", "left")
            .select(
                *columns,
                F.coalesce(F.col("seq") == F.col("gone_at"), F.lit(False)).alias("done"),
                F.expr("gone_at IS NULL AND (actor_gone_at IS NULL OR actor_gone_at > seq)").alias("open"),
            )
        )
        done.append(marked.where("done").select(*columns))
        open_requests = marked.where("open").select(*columns)
        if len(done) > 8:
            done = [written(_union(done))]
        if open_requests.isEmpty():
            return written(_union(done))


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def delete_users(requests: DataFrame, users: DataFrame, tasks: DataFrame) -> Patched:
    """Delete users for good: a request has ``seq``, ``actor_id`` and ``user_id``.

    The actor must be known (404), active (400) and a superuser (403), the user must exist
    (404), must not be the actor (403) and must own no task (500, the foreign key refuses).
    Requests are decided in ``seq`` order: a user deleted earlier in the batch is gone, as the
    one to delete and as an actor, so two superusers can't delete each other.
    """
    known = keys_present(
        requests.select("user_id"), users.select(F.col("id").alias("user_id")), "user_id"
    ).withColumn("known", F.lit(True))
    owners = keys_present(requests, tasks, "user_id").withColumn("owns_tasks", F.lit(True))
    seen = lookup_join(lookup_join(requests, actors(users, "actor_id"), "actor_id"), known, "user_id", keys_from=requests)
    judged = lookup_join(seen, owners, "user_id", keys_from=requests)
    no_right = ~F.coalesce("actor_is_superuser", F.lit(False))
    outcome = (
        F.when(gate_outcome().isNotNull(), gate_outcome())
        .when(no_right, F.lit(FORBIDDEN))
        .when(F.col("known").isNull(), F.lit(NOT_FOUND))
        .when(F.col("user_id") == F.col("actor_id"), F.lit(FORBIDDEN))
        .when(F.col("owns_tasks"), F.lit(SERVER_ERROR))
        .otherwise(F.lit(OK))
    )
    reason = (
        F.when(gate_reason().isNotNull(), gate_reason())
        .when(no_right, F.lit(NO_PERMISSION_GATE))
        .when(F.col("outcome") == NOT_FOUND, F.lit(USER_NOT_FOUND))
        .when(F.col("outcome") == FORBIDDEN, F.lit(NO_SELF_DELETE))
        .when(F.col("outcome") == SERVER_ERROR, F.lit(OWNS_TASKS))
    )
    decided = settle(
        judged.withColumn("outcome", outcome)
        .withColumn("reason", reason)
        .select("seq", "actor_id", "user_id", "outcome", "reason", no_right.alias("no_right"))
    )
    open_requests = decided.where(F.col("outcome") == OK).select("seq", "actor_id", "user_id")
    deleting = _delete_rounds(open_requests)
    gone = deleting.select("user_id", F.col("seq").alias("gone_at"))
    actor_gone = deleting.select(F.col("user_id").alias("actor_id"), F.col("seq").alias("actor_gone_at"))
    final = lookup_join(lookup_join(decided, gone, "user_id"), actor_gone, "actor_id", keys_from=decided)
    no_actor = F.coalesce(F.col("actor_gone_at") < F.col("seq"), F.lit(False))
    # only a superuser, who passed the gate, learns that the user is gone
    no_user = F.coalesce((F.col("gone_at") < F.col("seq")) & ~F.col("no_right"), F.lit(False)) & (
        F.coalesce("reason", F.lit("")) != ACTOR_INACTIVE
    )
    outcomes = final.select(
        "seq",
        "actor_id",
        "user_id",
        F.when(no_actor | no_user, F.lit(NOT_FOUND)).otherwise(F.col("outcome")).alias("outcome"),
        F.when(no_actor, F.lit(ACTOR_NOT_FOUND)).when(no_user, F.lit(USER_NOT_FOUND)).otherwise(F.col("reason")).alias("reason"),
    )
    state = lookup_join(users, deleting.select(F.col("user_id").alias("id")), "id", "left_anti", unique=True)
    return Patched(state.select(*users.columns), outcomes)


def seed_if_absent(base: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """The table plus the seed rows whose key it does not have."""
    there = keys_present(seed, base, key)
    return base.unionByName(lookup_join(seed, there, key, "left_anti", unique=True).select(*base.columns))


# What a patch does to the order of things, ids as text. ``claim`` is an email that must be free,
# ``fault`` what else refuses the patch, ``new_*`` the flags it sets.
_UPDATE = "seq", "id", "actor_id", "email", "claim", "moves", "fault", "new_active", "new_superuser"
_DECIDED = "seq long, outcome int, reason string"


def _with_state(rows: DataFrame, state: DataFrame, by_actor: bool) -> DataFrame:
    """Patches beside what they meet in ``state`` (``id, email, is_active, is_superuser``): the
    user's own email, who holds the claimed one, and the actor."""
    own = state.select("id", F.lit(True).alias("known"), F.col("email").alias("email_now"))
    holders = state.select(F.col("email").alias("claim"), F.col("id").alias("holder_now"))
    seen = shuffle_join(shuffle_join(rows, own, "id", "left"), holders, "claim", "left")
    if by_actor:
        seen = shuffle_join(seen, actors(state, "actor_id"), "actor_id", "left")
    return seen


def _in_order(by_actor: bool, superusers: bool):
    """An ordered pass over patches with their state: who holds an email changes as it goes."""
    gone, idle, forbidden = (NOT_FOUND, ACTOR_NOT_FOUND), (BAD_REQUEST, ACTOR_INACTIVE), (FORBIDDEN, NO_PERMISSION_GATE)
    unknown, held, done, failed = (NOT_FOUND, ID_NOT_FOUND), (CONFLICT, EMAIL_EXISTS_ON_UPDATE), (OK, None), SERVER_ERROR

    # nested, so that it travels to the workers by value
    def decide(part):
        names = list(part.columns)

        def records():  # one at a time, as a dict takes more memory than the row it holds
            return (dict(zip(names, row, strict=True)) for row in zip(*(part[c] for c in names), strict=True))

        email, holder, flags = {}, {}, {}
        for r in records():
            if r["known"]:
                email[r["id"]] = r["email_now"]
                holder[r["email_now"]] = r["id"]
            if r["holder_now"] is not None:
                holder[r["claim"]] = r["holder_now"]
            if by_actor and r["actor_is_active"] is not None:
                flags[r["actor_id"]] = [r["actor_is_active"], r["actor_is_superuser"]]
        out = []
        for r in records():
            actor, user, claim = flags.get(r["actor_id"]), r["id"], r["claim"]
            if by_actor and actor is None:
                verdict = gone
            elif by_actor and not actor[0]:
                verdict = idle
            elif by_actor and superusers and not actor[1]:
                verdict = forbidden
            elif not r["known"]:
                verdict = unknown
            elif claim is not None and holder.get(claim, user) != user:
                verdict = held
            elif r["fault"] is not None:
                verdict = (failed, r["fault"])
            else:
                verdict = done
                if r["moves"]:
                    if holder.get(email[user]) == user:
                        del holder[email[user]]
                    email[user] = r["email"]
                    if claim is not None:
                        holder[claim] = user
                if user in flags:
                    for k, name in enumerate(("new_active", "new_superuser")):
                        if r[name] is not None:
                            flags[user][k] = r[name]
            out.append((r["seq"], *verdict))
        return type(part)(out, columns=["seq", "outcome", "reason"])

    return decide


def _update_round(rows: DataFrame, state: DataFrame, by_actor: bool, superusers: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patches whose outcome no open earlier one can change, the others, and the state after them.

    A patch waits for earlier open ones that may change its actor's flags, claim its email, or take
    that email's holder elsewhere; one that is carried out also for earlier ones of the same user,
    and for those that still read what it changes. The first open patch of all never waits.
    """

    def least(some: DataFrame, key: str, as_key: str, name: str) -> DataFrame:
        return some.groupBy(F.col(key).alias(as_key)).agg(F.min("seq").alias(name))

    live = rows.where("fault IS NULL")
    flagging = F.col("new_active").isNotNull() | F.col("new_superuser").isNotNull()
    seen = _with_state(rows, state, by_actor)
    for some, key, as_key, name in (
        (live, "id", "id", "of_user"),
        (rows, "claim", "claim", "of_claim"),
        (rows, "claim", "email_now", "of_own_email"),
        (live.where("moves"), "id", "holder_now", "leaves"),
        (live.where(flagging), "id", "actor_id", "of_actor"),
        (rows, "actor_id", "id", "as_actor"),
    ):
        seen = shuffle_join(seen, least(some, key, as_key, name), as_key, "left")
    seq, waits = F.col("seq"), lambda name: F.coalesce(F.col(name) < seq, F.lit(False))
    held = F.coalesce(F.col("holder_now") != F.col("id"), F.lit(False))
    mine = F.coalesce(F.col("holder_now") == F.col("id"), F.lit(False))
    refused = F.lit(None).cast("int")
    why = F.lit(None).cast("string")
    if by_actor:
        refused = _superuser_outcome() if superusers else gate_outcome()
        why = _superuser_reason() if superusers else gate_reason()
    outcome = (
        F.when(waits("of_actor") if by_actor else F.lit(False), F.lit(None))
        .when(refused.isNotNull(), refused)
        .when(F.col("known").isNull(), F.lit(NOT_FOUND))
        .when(held, F.when(~waits("leaves"), F.lit(CONFLICT)))
        .when(F.col("claim").isNotNull() & F.when(mine, waits("of_user")).otherwise(waits("of_claim")), F.lit(None))
        .when(F.col("fault").isNotNull(), F.lit(SERVER_ERROR))
        .when(waits("of_user") | (F.col("moves") & waits("of_own_email")) | (flagging & waits("as_actor")), F.lit(None))
        .otherwise(F.lit(OK))
    )
    reason = (
        F.when(refused.isNotNull(), why)
        .when(F.col("outcome") == NOT_FOUND, F.lit(ID_NOT_FOUND))
        .when(F.col("outcome") == CONFLICT, F.lit(EMAIL_EXISTS_ON_UPDATE))
        .when(F.col("outcome") == SERVER_ERROR, F.col("fault"))
    )
    marked = written(seen.withColumn("outcome", outcome.cast("int")).withColumn("reason", reason).select(*_UPDATE, "outcome", "reason"))
    carried = marked.where(F.col("outcome") == OK).select(
        "id", F.when(F.col("moves"), F.col("email")).alias("email_new"), "new_active", "new_superuser"
    )
    after = shuffle_join(state, carried, "id", "left").select(
        "id",
        F.coalesce("email_new", "email").alias("email"),
        F.coalesce("new_active", "is_active").alias("is_active"),
        F.coalesce("new_superuser", "is_superuser").alias("is_superuser"),
    )
    decided = marked.where("outcome IS NOT NULL").select("seq", "outcome", "reason")
    return decided, marked.where("outcome IS NULL").select(*_UPDATE), written(after)


def _decide_updates(rows: DataFrame, state: DataFrame, by_actor: bool, superusers: bool) -> DataFrame:
    """``seq, outcome, reason`` as one by one: an ordered pass over few patches; of more, rounds
    first, then passes over the components of users and emails, and further rounds over those
    components that are too large for a pass."""
    limit, rounds = pass_limit(rows.sparkSession), 3
    decide, done = _in_order(by_actor, superusers), []
    while True:
        for _ in range(rounds):
            count = rows.count()
            if count <= limit:
                if count or not done:
                    done.append(one_pass(_with_state(rows, state, by_actor), decide, _DECIDED))
                return written(_union(done))
            decided, rows, state = _update_round(rows, state, by_actor, superusers)
            done.append(decided)
            if len(done) > 8:
                done = [written(_union(done))]
        if limit:
            # an actor ties patches together only where a patch may change that actor
            flagged = rows.where("new_active IS NOT NULL OR new_superuser IS NOT NULL")
            changed = flagged.select(F.col("id").alias("actor_id")).distinct().withColumn("changed", F.lit(True))
            seen = written(shuffle_join(_with_state(rows, state, by_actor), changed, "actor_id", "left"))
            keys = [("id", F.lit(True)), ("claim", F.lit(True)), ("email_now", F.col("moves")), ("actor_id", F.col("changed"))]
            links = [
                F.when(use & F.col(c).isNotNull(), F.xxhash64(F.lit("mail" if c in ("claim", "email_now") else "user"), c))
                for c, use in keys
            ]
            decided, rows = by_components(seen, F.array_compact(F.array(*links)), decide, _DECIDED)
            done.append(written(decided))
            rows = written(rows.select(*_UPDATE))
        rounds *= 2


def update_users(patches: DataFrame, users: DataFrame, form: str = "admin") -> Patched:
    """Patch users: ``seq``, ``id``, the form's fields and ``present``, the names it carries.

    The admin form may change any field; the self form full name and email only, other
    fields it carries are ignored. With an ``actor_id`` the admin form asks for a known (404), active
    (400) superuser (403); in the self form the user is the actor. A missing id is 404; an email
    held by another user is 409 and leaves the whole patch out; an explicit null in a field that
    must have a value is 500. The result equals applying the patches one by one in ``seq`` order:
    an email that an earlier patch gave up is free, one that it took is held, and a flag it
    changed counts for that user's own requests.
    """
    if form not in ("admin", "self"):
        raise ValueError("form must be 'admin' or 'self'")
    admin = form == "admin"
    fields = ADMIN_FIELDS if admin else SELF_FIELDS
    by_actor = not admin or "actor_id" in patches.columns
    sent = F.coalesce(F.array_contains("present", "email"), F.lit(False)) & F.col("email").isNotNull()
    flag = lambda name: (
        F.when(F.array_contains("present", name), F.col(name)) if admin else F.lit(None).cast("boolean")
    )
    actor = F.col("actor_id" if admin else "id") if by_actor else F.lit(None)
    staged = written(
        patches.select(
            F.col("seq").cast("long").alias("seq"),
            F.col("id").cast("string").alias("id"),
            actor.cast("string").alias("actor_id"),
            F.when(sent, F.col("email")).alias("email"),
            F.when(sent & (F.col("email") != ""), F.col("email")).alias("claim"),
            sent.alias("moves"),
            null_fault([f for f in fields if f in _NOT_NULL]).alias("fault"),
            flag("is_active").alias("new_active"),
            flag("is_superuser").alias("new_superuser"),
        )
    )
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in users.columns else F.lit(True).alias(c) for c in ("is_active", "is_superuser")]
    people = users.select(F.col("id").cast("string").alias("id"), "email", *flags)
    asked = staged.select("id").union(staged.select("actor_id")).where("id IS NOT NULL").distinct()
    state = lookup_join(people, asked, "id", "left_semi", unique=True).union(
        lookup_join(people, staged.select(F.col("claim").alias("email")).distinct(), "email", "left_semi", unique=True).select(*people.columns)
    )
    decided = _decide_updates(staged.select(*_UPDATE), written(state.distinct()), by_actor, admin)
    final = settle(
        lookup_join(patches, decided, "seq", unique=True).select(*patches.columns, "outcome", "reason")
    )
    changes = apply_patches(users, final.where(F.col("outcome") == OK), fields)
    return Patched(changes, final.select("seq", "id", "outcome", "reason"))
