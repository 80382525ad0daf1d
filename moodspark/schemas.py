"""Table schemas.  Commenter names are not part of any schema: they are never read."""

ARTICLES = "id bigint, url string, title string, content string"
COMMENTS_VOTED = "id bigint, article_id bigint, comment string, upvotes int, downvotes int"
COMMENTS_PLAIN = "id bigint, article_id bigint, comment string"
REACTIONS = "id bigint, article_id bigint, emotion string, count bigint"
POST_COMMENTS = (
    "id bigint, account_name string, post_url string, post_caption string, comment string"
)
LABELLED_POST_COMMENTS = POST_COMMENTS + ", sentiment string"
MAJORITY_LABELS = "post_caption string, average_sentiment string"
POST_SUMMARIES = "post_url string, caption string, comment_count bigint, summary string"
ARTICLE_SUMMARIES = "source string, article_id bigint, title string, summary string"
EVALUATION = (
    "article_id string, source string, comment string, clean_comment string,"
    " sentiment string, true_sentiment string"
)
PREDICTIONS = (
    "article_id string, source string, comment string, clean_comment string, sentiment string"
)
PAGES = "page_id bigint, url string, html string"


def keyed_by(schema: str, key_type: str) -> str:
    """The same columns with keys (id, article_id) of another type."""
    return schema.replace("id bigint", f"id {key_type}")
