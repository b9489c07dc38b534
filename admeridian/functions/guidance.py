"""What each kind of signal leaves open, and what to look at before acting on it: (cannot_rule_out, check_next)."""

GUIDANCE = {
    "tracking_break": ("Which part broke: tag, page, checkout or consent banner. Only the break itself is measured.", "Test that tags fire and thank-you pages still exist; leave campaigns alone until conversions are counted again."),
    "auto_applied_changes": ("That the automatic changes did harm, or good: what follows a change need not come from it.", "Go through the change history and switch off the kinds of recommendation that do not suit the account."),
    "suspicious_primary_conversion": ("That the small step was made a goal on purpose, for want of larger ones.", "Ask whether the action earns money; if it does not, make it secondary so that bidding stops chasing it."),
    "duplicate_primary_conversions": ("That several actions of a category count different sources rather than one event twice.", "Compare the actions of the category and keep one of those that count the same event."),
    "missing_conversion_value": ("That a conversion of this business has no amount of its own.", "Where sales differ in worth, send values with conversions; value bidding needs them."),
    "low_quality_score": ("What the low score costs, or which element of the page to change.", "Start with whichever of expected click rate, relevance and landing page is rated below average."),
    "over_segmentation": ("That the many campaigns serve audiences that need to be apart.", "Merge campaigns of like audiences; keep those apart that differ by region, language or line of business."),
    "missing_brand_separation": ("That a split would pay: small accounts have too few conversions for two campaigns.", "Split brand from the rest where each part keeps some thirty conversions a month."),
    "missing_extensions": ("How much the missing assets matter to click rate here.", "Add the kinds of asset that are missing."),
    "low_negative_ratio": ("That the short list of negatives lets much waste through; only search terms show it.", "Read the search terms and exclude those that have nothing to do with the offer."),
    "broad_without_smart_bidding": ("That broad match is wasting money here.", "Bid by conversions, or narrow the match types."),
    "budget_capped": ("That the missed impressions would have paid: demand is seen, the cost of more of it is not.", "Raise the budget by a fifth for two weeks and look at the cost of the additional conversions."),
    "budget_limited_is": ("That the share lost to budget could be won at a profit.", "Try a larger budget for a while and follow the cost of the additional conversions."),
    "no_pmax_campaigns": ("That this campaign type suits the account's goals and product data.", "Consider one where products are sold from a feed in good order."),
    "no_search_campaigns": ("That doing without search is a choice.", "See whether brand and generic queries with intent go unanswered."),
    "cpa_spike": ("Weaker season, new bidders, a worse page, or effects of other channels.", "Look at auction insights, page speed and content, and search volume."),
    "cpa_change": ("Season, competition, the page, or other channels behind the move.", "Look at auction insights, the page and search volume before naming a cause."),
    "cvr_drop": ("Changed page or prices, other queries or audiences, or a season of little intent.", "Compare the page with its earlier state, and the search terms of both periods."),
    "cvr_change": ("Page, prices, queries or season; the move may pass either way.", "Hold page and search terms of both windows side by side."),
    "budget_capped_change": ("That the move from week to week is more than the auction's usual swing.", "See what happened to budget and competition in both windows."),
    "budget_limited_is_change": ("That lost share moved because of the budget and not by chance.", "See how the budget stood in both windows."),
    "roas_contamination": ("That generic campaigns win customers who later buy through brand; last click cannot tell.", "Look at assisted conversions: does generic search come before brand?"),
    "roas_contamination_unsafe": ("That generic campaigns assist brand, or that odd values distort the blend.", "Check volumes of both sides and assisted conversions before moving budget."),
    "cross_account_cpa_outlier": ("Other goals, markets, prices or ages than the accounts it is compared with.", "Compare goals and regions with these accounts, and what a conversion is worth."),
    "vertical_cpa_benchmark": ("That market averages hide this kind of business, region, price and goal.", "Set goals and prices against the branch's usual ones, and look at return as well as cost."),
    "pmax_conversion_inflation": ("That the higher rate is real interest and not another way of counting.", "Compare which actions both campaign types count, and the value of a conversion."),
    "search_terms_waste": ("That terms without conversions helped others that are credited elsewhere.", "Look at assists, and wait for enough clicks, before excluding terms."),
    "pmax_dominance_no_shopping": ("Where the spend goes inside the campaign; display may find new customers too.", "Check the product feed and search themes; an experiment tells what is gained."),
    "pmax_low_conv_volume": ("That few but clean conversions suffice, or that the campaign is still learning.", "Look at the campaign's age; after some months, pool it or change the bidding for a time."),
    "pmax_low_conv_volume_change": ("That the swing is more than the first weeks' learning.", "Wait until learning is over."),
    "insufficient_conversions_for_strategy": ("That the campaign does well with less, or is young.", "Look at its age; if it is old and still small, merge it or bid for clicks for a time."),
}
#: For any other kind.
UNKNOWN = ("Any cause: nothing is known about this kind of signal.", "Look into it by hand, and describe the kind.")
