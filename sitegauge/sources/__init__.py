"""Reading fetched sitemaps, pages and URL lists; the page vector store."""
