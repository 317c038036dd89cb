"""Named views, registered queries and their reference SQL, plan inspection."""
