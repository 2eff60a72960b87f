"""Plans that rewrite a query for speed."""
