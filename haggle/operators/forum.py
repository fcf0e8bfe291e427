"""Discussion lists: counts of comments, names of authors, threads of replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.sources.storage import shared_folder


def through(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: tuple[str, str], right_key: tuple[str, str]) -> DataFrame:
    """left and right rows that a bridge row connects, as users and the deals that they have marked.

    left_key, right_key: the names of a key in left (or right) and in the bridge.
    """
    return left.join(bridge, left[left_key[0]] == bridge[left_key[1]]).join(right, bridge[right_key[1]] == right[right_key[0]])


def with_child_count(parents: DataFrame, children: DataFrame, key: str, foreign_key: str, name: str) -> DataFrame:
    """parents with the number of their children, 0 for none. Children are counted before they meet their parents."""
    counts = children.groupBy(F.col(foreign_key).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def with_owner(rows: DataFrame, owners: DataFrame, foreign_key: str, key: str, columns: dict[str, str]) -> DataFrame:
    """rows with columns of their owners (new name: owner's column). Spark broadcasts owners only if they are small."""
    own = owners.select(F.col(key).alias("_owner"), *(F.col(c).alias(n) for n, c in columns.items()))
    return rows.join(own, F.col(foreign_key) == F.col("_owner")).drop("_owner")


def post_list(posts: DataFrame, users: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts with the name of their author and the number of their comments, newest first: the nine columns that the list shows."""
    named = with_owner(posts, users, "author_id", "id", {"user_name": "user_id"})
    counted = with_child_count(named, comments, "id", "post_id", "comment_count")
    return counted.select("id", "post_type", "title", "content", F.col("author_id").alias("author"), "user_name", "view_count", "comment_count", "created_at").orderBy(F.desc("created_at"), F.desc("id"))


def thread(comments: DataFrame, post: object = None, parent: object = None) -> DataFrame:
    """Comments of a post, or direct replies to one comment of it, oldest first."""
    if post is not None:
        comments = comments.where(F.col("post_id") == F.lit(post))
    if parent is not None:
        comments = comments.where(F.col("parent_id") == F.lit(parent))
    return comments.orderBy("created_at", "id")


def paths(comments: DataFrame, with_path: bool = True, most_rounds: int = 64) -> DataFrame:
    """Every comment with its root, depth (0 for a root) and, if asked for, the path of ids from the root.

    A comment looks to its parent, then to what its parent looks to, and so on: each round doubles how far up everyone sees, so a tree of depth d takes log2(d) rounds
    and no depth is too much (a table of 2 to the most_rounds comments would be an error). Every round is written out. Comments that no root leads to, for want of a parent or by a circle, are in no tree
    and go.
    """
    reply = F.col("parent_id").isNotNull()
    shared_folder(comments.sparkSession)
    path = [F.array("id").alias("path")] if with_path else []
    start = comments.select("post_id", "id", F.col("parent_id").alias("up"), F.when(~reply, F.col("id")).alias("root_id"), reply.cast("int").alias("depth"), *path).checkpoint()
    done, open_, n_open = start.where("up is null"), start.where("up is not null"), -1
    for k in range(most_rounds + 1):
        n = open_.count()
        if n in (0, n_open):  # a round brings at least the nearest to their root: what is left leads round in circles
            return done.drop("up")
        if k == most_rounds:
            break
        n_open, known = n, done.unionByName(open_)
        seen = known.select(*(F.col(c).alias(f"its_{c}") for c in known.columns))
        longer = [F.concat("its_path", "path").alias("path")] if with_path else []
        # of a missing parent nothing is seen, and the comment goes
        met = open_.join(seen, (F.col("up") == F.col("its_id")) & (F.col("post_id") == F.col("its_post_id")))
        now = met.select("post_id", "id", F.col("its_up").alias("up"), F.col("its_root_id").alias("root_id"), (F.col("depth") + F.col("its_depth")).alias("depth"), *longer).checkpoint()
        done, open_ = done.unionByName(now.where("up is null")), now.where("up is not null")
    raise ValueError(f"more than {most_rounds} rounds")


def nested_replies(comments: DataFrame) -> DataFrame:
    """Each comment with its direct replies, newest first, as an array of structs."""
    replies = comments.where("parent_id is not null").groupBy(F.col("post_id"), F.col("parent_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("created_at", F.col("id").alias("reply"), "content")), asc=False), lambda r: F.struct(r["reply"].alias("id"), r["content"].alias("content"), r["created_at"].alias("created_at"))).alias("replies")
    )
    return comments.join(replies, ["post_id", "id"], "left")


def comment_list(comments: DataFrame) -> DataFrame:
    """Comments as the API shows them: id, post, parent, author, content, created_at and replies, the direct ones newest first as an array of (id, content, created_at)."""
    own = nested_replies(comments.select("post_id", "id", "parent_id", "author_id", "content", "created_at"))
    return own.select("id", F.col("post_id").alias("post"), F.col("parent_id").alias("parent"), F.col("author_id").alias("author"), "content", "created_at", "replies")
