"""The shop's 25 tables as data: columns, code lists, keys and delete rules.

Readers, labels, quality checks, browsing and cascading deletes are all driven by
this one description, so a new column or table is added in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- Fixed values: codes and the labels shown for them --------------------------------
ROLE = {"student": "學生", "teacher": "老師"}
LEVEL = {"beginner": "初階", "intermediate": "中階", "advanced": "高階"}
DISCOUNT_TYPE = {"amount": "固定金額折扣", "percent": "百分比折扣"}
USER_COUPON_STATUS = {"unused": "未使用", "used": "已使用", "expired": "已過期"}
ORDER_STATUS = {"pending": "待付款", "paid": "已付款", "cancelled": "已取消", "refunded": "已退款"}
PAYMENT_METHOD = {
    "credit_card": "信用卡",
    "atm": "ATM轉帳",
    "line_pay": "LINE Pay",
    "cash": "現金",
    "mock": "模擬付款",
}
PAYMENT_STATUS = {"pending": "待付款", "paid": "付款成功", "failed": "付款失敗", "refunded": "已退款"}
REFUND_STATUS = {
    "pending": "退款審核中",
    "approved": "退款通過",
    "rejected": "退款拒絕",
    "completed": "退款完成",
}
AUDIT_STATUS = {"pending": "待審核", "approved": "審核通過", "rejected": "審核退回"}
NO_CATEGORY = "未分類"
SEVERAL_COURSES = "多課程訂單"
PURCHASE_NOTICE_TITLE = "購買成功通知"
# --------------------------------------------------------------------------------------

CASCADE = "cascade"
SET_NULL = "set_null"

_SPARK_TYPE = {
    "id": T.LongType(),
    "text": T.StringType(),
    "int": T.IntegerType(),
    "uint": T.LongType(),
    "smallint": T.IntegerType(),
    "bool": T.BooleanType(),
    "time": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    null: bool = False
    blank: bool = False
    max_length: int | None = None
    choices: dict[str, str] | None = None
    default: object = None
    refers_to: str | None = None
    on_delete: str | None = None
    shape: str | None = None

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK_TYPE[self.kind]

    @property
    def non_negative(self) -> bool:
        return self.kind in ("uint", "smallint")


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    one_to_one: tuple[str, ...] = ()
    case_insensitive: tuple[str, ...] = field(default=())

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, True) for c in self.columns])

    @property
    def foreign_keys(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.refers_to)

    @property
    def coded(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.choices)

    def __getitem__(self, column: str) -> Column:
        return next(c for c in self.columns if c.name == column)


def _ref(name: str, table: str, null: bool = False, on_delete: str = CASCADE) -> Column:
    return Column(name, "id", null=null, refers_to=table, on_delete=on_delete)


def _chars(name: str, size: int, **more) -> Column:
    return Column(name, "text", max_length=size, **more)


def _body(name: str, null: bool = False) -> Column:
    return Column(name, "text", null=null, blank=null)


def _code(name: str, choices: dict[str, str], size: int = 20, default: str | None = None) -> Column:
    return Column(name, "text", max_length=size, choices=choices, default=default)


def _time(name: str, null: bool = False) -> Column:
    return Column(name, "time", null=null)


def _table(name: str, *columns: Column, **more) -> Table:
    return Table(name, (Column("id", "id"), *columns), **more)


_ALL = (
    _table(
        "users",
        _chars("username", 150),
        Column("email", "text", blank=True, max_length=254, shape="email"),
        Column("is_staff", "bool", default=False),
        Column("is_superuser", "bool", default=False),
        unique=(("username",),),
    ),
    _table("profiles", _ref("user_id", "users"), _code("role", ROLE), one_to_one=("user_id",)),
    _table(
        "categories",
        _chars("name", 100),
        _body("description", null=True),
        _time("created_at"),
        unique=(("name",),),
        case_insensitive=("name",),
    ),
    _table(
        "courses",
        _chars("title", 200),
        _ref("teacher_id", "users"),
        _ref("category_id", "categories", null=True, on_delete=SET_NULL),
        Column("price", "int"),
        _body("description"),
        _chars("image", 100, null=True, blank=True),
        _code("level", LEVEL, default="beginner"),
        Column("is_published", "bool", default=True),
        _time("created_at"),
    ),
    _table(
        "chapters",
        _ref("course_id", "courses"),
        _chars("title", 200),
        _body("description", null=True),
        Column("sort_order", "uint", default=1),
        _time("created_at"),
    ),
    _table(
        "lessons",
        _ref("chapter_id", "chapters"),
        _chars("title", 200),
        _body("content", null=True),
        Column("video_url", "text", null=True, blank=True, max_length=200, shape="url"),
        Column("duration_minutes", "uint", default=0),
        Column("sort_order", "uint", default=1),
        Column("is_free_preview", "bool", default=False),
        _time("created_at"),
    ),
    _table(
        "enrollments",
        _ref("student_id", "users"),
        _ref("course_id", "courses"),
        _time("purchased_at"),
        unique=(("student_id", "course_id"),),
    ),
    _table(
        "learning_records",
        _ref("user_id", "users"),
        _ref("course_id", "courses"),
        _ref("lesson_id", "lessons", null=True, on_delete=SET_NULL),
        Column("minutes", "uint", default=30),
        _time("watched_at"),
    ),
    _table(
        "coupons",
        _chars("code", 50),
        _chars("name", 100),
        _code("discount_type", DISCOUNT_TYPE),
        Column("discount_value", "uint"),
        Column("min_spend", "uint", default=0),
        _time("start_date"),
        _time("end_date"),
        Column("usage_limit", "uint", default=0),
        Column("is_active", "bool", default=True),
        _time("created_at"),
        unique=(("code",),),
        case_insensitive=("code",),
    ),
    _table(
        "user_coupons",
        _ref("user_id", "users"),
        _ref("coupon_id", "coupons"),
        _code("status", USER_COUPON_STATUS, default="unused"),
        _time("received_at"),
        _time("used_at", null=True),
    ),
    _table(
        "promotions",
        _chars("name", 100),
        _body("description", null=True),
        _code("discount_type", DISCOUNT_TYPE),
        Column("discount_value", "uint"),
        _time("start_date"),
        _time("end_date"),
        Column("is_active", "bool", default=True),
        _time("created_at"),
    ),
    Table(
        "promotion_courses",
        (_ref("promotion_id", "promotions"), _ref("course_id", "courses")),
        unique=(("promotion_id", "course_id"),),
    ),
    _table(
        "carts",
        _ref("user_id", "users"),
        _time("created_at"),
        _time("updated_at"),
        one_to_one=("user_id",),
    ),
    _table(
        "cart_items",
        _ref("cart_id", "carts"),
        _ref("course_id", "courses"),
        _time("added_at"),
        unique=(("cart_id", "course_id"),),
    ),
    _table(
        "orders",
        _ref("user_id", "users"),
        _ref("course_id", "courses", null=True),
        _ref("coupon_id", "coupons", null=True, on_delete=SET_NULL),
        Column("original_price", "uint"),
        Column("discount_amount", "uint", default=0),
        Column("final_price", "uint"),
        _code("status", ORDER_STATUS, default="paid"),
        _time("created_at"),
    ),
    _table(
        "order_items",
        _ref("order_id", "orders"),
        _ref("course_id", "courses"),
        Column("price", "uint"),
    ),
    _table(
        "coupon_usages",
        _ref("user_id", "users"),
        _ref("coupon_id", "coupons"),
        _ref("order_id", "orders"),
        Column("discount_amount", "uint"),
        _time("used_at"),
        one_to_one=("order_id",),
    ),
    _table(
        "payments",
        _ref("order_id", "orders"),
        _code("method", PAYMENT_METHOD, size=30, default="mock"),
        Column("amount", "uint"),
        _code("status", PAYMENT_STATUS, default="paid"),
        _chars("transaction_no", 100, null=True, blank=True),
        _time("paid_at", null=True),
        _time("created_at"),
    ),
    _table(
        "refunds",
        _ref("order_id", "orders"),
        _ref("user_id", "users"),
        Column("amount", "uint"),
        _body("reason"),
        _code("status", REFUND_STATUS, default="pending"),
        _time("created_at"),
        _time("processed_at", null=True),
    ),
    _table(
        "favorites",
        _ref("user_id", "users"),
        _ref("course_id", "courses"),
        _time("created_at"),
        unique=(("user_id", "course_id"),),
    ),
    _table(
        "reviews",
        _ref("user_id", "users"),
        _ref("course_id", "courses"),
        Column("rating", "smallint", default=5),
        _body("comment", null=True),
        _time("created_at"),
        _time("updated_at"),
        unique=(("user_id", "course_id"),),
    ),
    _table(
        "notifications",
        _ref("user_id", "users"),
        _chars("title", 200),
        _body("content"),
        Column("is_read", "bool", default=False),
        _time("created_at"),
    ),
    _table(
        "questions",
        _ref("user_id", "users"),
        _ref("course_id", "courses"),
        _ref("lesson_id", "lessons", null=True, on_delete=SET_NULL),
        _chars("title", 200),
        _body("content"),
        _time("created_at"),
    ),
    _table(
        "answers",
        _ref("question_id", "questions"),
        _ref("user_id", "users"),
        _body("content"),
        _time("created_at"),
    ),
    _table(
        "audits",
        _ref("course_id", "courses"),
        _ref("reviewer_id", "users", null=True, on_delete=SET_NULL),
        _code("status", AUDIT_STATUS, default="pending"),
        _body("comment", null=True),
        _time("created_at"),
        _time("reviewed_at", null=True),
    ),
)

TABLES: dict[str, Table] = {t.name: t for t in _ALL}


def table(name: str) -> Table:
    return TABLES[name]
