"""Named actions and the checked queries of the package."""
