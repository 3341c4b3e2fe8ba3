from .feeds import compact_reviews, compact_watched, review_feed, reviews_after, watch_feed, watch_totals

__all__ = ["compact_reviews", "compact_watched", "review_feed", "reviews_after", "watch_feed", "watch_totals"]
