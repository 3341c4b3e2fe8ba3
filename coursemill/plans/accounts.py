"""Sign-ups, user updates, and the courses teachers create and edit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strip
from ..operators.lookup import only_existing
from ..operators.merging import absent, insert_if_absent, upsert, with_new_ids
from ..operators.quality import SHAPES
from ..schema import ROLE, table
from ..shop import Shop
from ..store import Store


def sign_ups(shop: Shop, forms: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """New (users, profiles) from forms ``(id, username, email, role)``; ``id`` gives the order.

    A form is refused when a field is missing or too long, the address has no shape, the role is
    unknown, or the name is taken, by an existing user or by an earlier form. User names differ by case,
    unlike coupon codes and category names. New rows get new ids in the order of the forms.
    """
    username, email = strip(F.col("username")), strip(F.col("email"))
    valid = (
        forms.select("id", username.alias("username"), email.alias("email"), "role")
        .filter((F.col("username") != "") & (F.char_length("username") <= table("users")["username"].max_length))
        .filter(F.col("email").rlike(SHAPES["email"]) & F.col("role").isin(list(ROLE)))
    )
    longest = table("users")["email"].max_length
    if longest:
        valid = valid.filter(F.char_length("email") <= longest)
    new = with_new_ids(shop["users"], absent(shop["users"], valid, ["username"], ["id"]), ["id"], store)
    new = store.keep(new, "sign-ups")
    users = new.select(
        "id", "username", "email", F.lit(False).alias("is_staff"), F.lit(False).alias("is_superuser")
    )
    profiles = new.select("id", F.col("id").alias("user_id"), "role")
    return users, with_new_ids(shop["profiles"], profiles, ["user_id"], store)


def upsert_users(shop: Shop, feed: DataFrame, store: Store) -> DataFrame:
    """Users after a feed ``(id, username, email, is_superuser)`` in id order.

    A known user gets the last address; the staff and superuser flags are only ever raised.
    """
    changes = feed.groupBy("username").agg(
        F.min("id").alias("id"),
        F.max_by("email", "id").alias("email"),
        F.max("is_superuser").alias("is_superuser"),
    )
    changes = changes.withColumn("is_staff", F.col("is_superuser"))
    return upsert(
        shop["users"],
        changes,
        "username",
        {
            "email": F.col("new.email"),
            "is_staff": F.col("old.is_staff") | F.col("new.is_superuser"),
            "is_superuser": F.col("old.is_superuser") | F.col("new.is_superuser"),
        },
        store,
    )


def ensure_profiles(shop: Shop, wanted: DataFrame, store: Store) -> DataFrame:
    """Profiles after making sure each of ``wanted(id, user_id, role)`` has one; existing roles stay."""
    return insert_if_absent(shop["profiles"], wanted, ["user_id"], ["id"], store)


def upsert_courses(shop: Shop, feed: DataFrame, store: Store) -> DataFrame:
    """Courses after a feed ``(id, title, teacher_id, category_id, price, level, description)`` keyed by title.

    The last row of a title wins, but a new course was created when its title first came; a course in the
    feed ends up published.
    """
    fields = ["teacher_id", "category_id", "price", "level", "description"]
    last = feed.groupBy("title").agg(
        F.min("id").alias("id"),
        F.min_by("created_at", "id").alias("created_at"),
        F.max_by(F.struct(*fields), F.col("id")).alias("_last"),
    )
    existing = shop["courses"]
    extra = [c for c in existing.columns if c not in {"id", "title", "is_published", "created_at", *fields}]
    changes = last.select(
        "id",
        "title",
        *[F.col(f"_last.{c}").alias(c) for c in fields],
        "created_at",
        F.lit(True).alias("is_published"),
        *[F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in extra],
    )
    return upsert(
        existing, changes, "title", {c: F.col(f"new.{c}") for c in [*fields, "is_published"]}, store
    )


def _valid_course_forms(shop: Shop, forms: DataFrame) -> DataFrame:
    """Forms of teachers with a title of allowed length, a price and a description."""
    teachers = shop["profiles"].filter(F.col("role") == "teacher")
    return (
        only_existing(forms, teachers, {"user_id": "user_id"})
        .withColumn("title", strip(F.col("title")))
        .withColumn("description", strip(F.col("description")))
        .filter((F.col("title") != "") & (F.char_length("title") <= table("courses")["title"].max_length))
        .filter((F.col("description") != "") & F.col("price").isNotNull())
    )


def course_drafts(shop: Shop, forms: DataFrame, store: Store) -> DataFrame:
    """New courses from ``(id, user_id, title, price, description, image, submitted_at)``.

    Level, publication and category are the defaults of a course nobody has edited yet.
    """
    courses = table("courses")
    drafts = _valid_course_forms(shop, forms).select(
        "id",
        "title",
        F.col("user_id").alias("teacher_id"),
        F.lit(None).cast("bigint").alias("category_id"),
        "price",
        "description",
        "image",
        F.lit(courses["level"].default).alias("level"),
        F.lit(courses["is_published"].default).alias("is_published"),
        F.col("submitted_at").alias("created_at"),
    )
    return with_new_ids(shop["courses"], drafts, ["created_at", "id"], store)


def course_edits(shop: Shop, forms: DataFrame) -> DataFrame:
    """Courses after edits ``(id, user_id, course_id, title, price, description, image, submitted_at)`` in time order.

    Only the owner's edits count; the last one gives title, price and description, the last one
    with a picture gives the picture.
    """
    owners = shop["courses"].select(F.col("id").alias("course_id"), F.col("teacher_id").alias("user_id"))
    own = _valid_course_forms(shop, forms).join(owners, ["course_id", "user_id"], "left_semi")
    order = F.struct("submitted_at", "id")
    with_image = F.when(F.col("image").isNotNull(), order)
    edits = own.groupBy("course_id").agg(
        F.max_by(F.struct("title", "price", "description"), order).alias("_edit"),
        F.max_by(F.col("image"), with_image).alias("_image"),
    )
    changed = F.col("_edit").isNotNull()
    new = {
        "title": F.when(changed, F.col("_edit.title")).otherwise(F.col("title")),
        "price": F.when(changed, F.col("_edit.price")).otherwise(F.col("price")),
        "description": F.when(changed, F.col("_edit.description")).otherwise(F.col("description")),
        "image": F.coalesce("_image", "image"),
    }
    courses = shop["courses"]
    return courses.join(edits, courses["id"] == edits["course_id"], "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in courses.columns]
    )
