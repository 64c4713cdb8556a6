"""SQL counterparts of the catalog queries, for an independent engine on the same tables.

Money is summed as DECIMAL and turned into a double last; dates and times are shown as text.
"""

from __future__ import annotations

import re


def email(key: str) -> str:
    return f"'customer' || lpad(cast({key} as varchar), 9, '0') || '@example.rw'"


KINDS = "['Real Estate','Financial','Vehicle','Personal','Business','Investment','Other']"
RELATIONS = "['Spouse','Child','Parent','Sibling','Friend','Charity','Other']"
ASSET = "l_orderkey * 10 + l_linenumber"
SEQ = "(l_partkey * 4096 + datediff('day', date '1992-01-01', cast(l_shipdate as date))) * 10 + l_linenumber"
REPORT = "timestamp '2001-08-01 00:00:00'"
AUDIT = "timestamp '2024-01-31 00:00:00'"
REPORT_TEXT = "'2001-08-01 00:00:00'"
WORTH = "cast(value * share_percent as decimal(30,4)) * 0.01"



def deletions(protected: bool) -> str:
    """Delete requests with code and reason; the first accepted one of a will ends the will."""
    confirmed = "force and coalesce(confirm_text, '') = 'DELETE-CONFIRM'"
    last_code, last_reason, may = "", "", confirmed
    if protected:
        last_code = "when status <> 'Draft' then -20031"
        last_reason = "when status <> 'Draft' then 'will is protected'"
        may = "false"
    return f"""
        with judged as (
          select d.*, w.status, w.will_id is not null as known,
            min(case when w.status = 'Draft' or ({may} and w.will_id is not null) then seq end)
              over (partition by d.will_id) as ending
          from e_deletions d left join e_wills w on w.will_id = d.will_id)
        select seq, will_id, force, confirm_text, status,
          case when will_id is null then -26000
            when not known or coalesce(seq > ending, false) then -26001
            when status <> 'Draft' and not force then -26002
            when status <> 'Draft' and not ({confirmed}) then -26004 {last_code} end as code,
          case when will_id is null then 'will id is missing'
            when not known or coalesce(seq > ending, false)
              then 'unknown will ' || cast(will_id as varchar)
            when status <> 'Draft' and not force then 'will is ' || status
            when status <> 'Draft' and not ({confirmed}) then 'confirmation text is missing'
            {last_reason} end as reason
        from judged"""


VIEWS = {
    "e_users": f"""
        select c_custkey as user_id, c_name as full_name,
          case when c_custkey % 17 = 0 then 'customer' || lpad(cast(c_custkey as varchar), 9, '0')
               else {email('c_custkey')} end as email,
          case when c_custkey % 13 = 0 then '12345'
               else '+250 78' || lpad(cast(c_custkey as varchar), 7, '0') end as phone_number,
          date '1960-01-01' + cast(c_custkey * 37 % 20000 as int) as date_of_birth,
          case when c_custkey % 19 = 0 then 'Kigali'
               else c_mktsegment || ' Street, Kigali' end as address,
          case when c_mktsegment = 'BUILDING' then 'testator'
               when c_mktsegment = 'AUTOMOBILE' then 'executor'
               when c_mktsegment = 'MACHINERY' then 'beneficiary'
               when c_mktsegment = 'FURNITURE' then 'admin'
               when c_mktsegment = 'HOUSEHOLD' and c_custkey % 2 = 0 then 'user' end
            as initial_role,
          cast(date '1995-01-01' + cast(c_custkey % 2000 as int) as timestamp) as created_at
        from customer""",
    "e_wills": """
        select o_orderkey as will_id, o_custkey as user_id,
          'Will ' || cast(o_orderkey as varchar) as title, o_orderpriority as description,
          case o_orderstatus when 'F' then 'Executed' when 'O' then 'Draft'
            else case when o_orderkey % 2 = 0 then 'Approved' else 'Executing' end end as status,
          o_orderdate as created_at, o_orderdate as last_updated_at
        from orders""",
    "e_assets": f"""
        select {ASSET} as asset_id, l_orderkey as will_id,
          'Asset ' || cast({ASSET} as varchar) as name,
          {KINDS}[cast(min(l_partkey) % 7 as int) + 1] as asset_type,
          cast(sum(cast(l_extendedprice as decimal(15,2))) as decimal(18,2)) as value
        from lineitem group by l_orderkey, l_linenumber""",
    "e_beneficiaries": f"""
        select s_suppkey as beneficiary_id, s_name as full_name,
          {RELATIONS}[s_nationkey % 7 + 1] as relation, {email('s_suppkey * 3')} as email
        from supplier""",
    "e_executors": f"""
        select o_orderkey * 10 + i as executor_id, o_orderkey as will_id,
          'Executor ' || cast((o_custkey * 7 + i) % 100 as varchar) as full_name,
          {email('(o_custkey * 7 + i) % 100')} as email,
          case when (i = 0 and o_orderkey % 8 <> 5) or (i = 1 and o_orderkey % 32 = 3)
               then 'Y' else 'N' end as is_primary
        from orders cross join (values (0), (1), (2)) t(i) where i < o_orderkey % 4""",
    "e_shares": f"""
        select asset_id * 100000 + l_suppkey as mapping_id, asset_id,
          l_suppkey as beneficiary_id,
          cast(sum(case when l_orderkey % 5 < 3 then cast(round(100.0 / n, 2) as decimal(5,2))
                   else cast(l_quantity * 2 as decimal(5,2)) end) as decimal(18,2))
            as share_percent
        from (select *, {ASSET} as asset_id,
                count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem)
        group by asset_id, l_suppkey""",
    "e_transfers": f"""
        select ({ASSET}) * 100000 + l_suppkey as transfer_id, {ASSET} as asset_id,
          l_suppkey as beneficiary_id, max(l_shipdate) as transfer_date,
          'clerk' || cast(l_orderkey % 10 as varchar) as approved_by,
          case when max(l_linestatus) = 'O' then 'Initiated'
               when max(l_returnflag) = 'A' then 'Failed' else 'Completed' end
            as transfer_status
        from lineitem join orders on l_orderkey = o_orderkey
        where o_orderstatus <> 'O'
        group by l_orderkey, l_linenumber, l_suppkey""",
    "e_requests": f"""
        select {SEQ} as seq, {ASSET} as asset_id,
          case when l_partkey % 10 = 0 then l_suppkey + 1 else l_suppkey end as beneficiary_id,
          l_shipdate as transfer_date, cast(l_quantity * 2 as decimal(7,2)) as share_percent
        from lineitem""",
    "e_documents": """
        select doc_id as document_id,
          case doc_id % 8 when 3 then 'PERSON' when 1 then ' asset ' when 5 then 'ASSET'
            when 7 then 'will' else 'WILL' end as related_entity,
          case when doc_id % 8 in (1, 5) then doc_id * 10 + doc_id % 9 else doc_id * 17 end
            as entity_id,
          'Document ' || cast(doc_id as varchar) as title,
          case lang when 'en' then 'PDF' when 'fr' then 'DOC' when 'de' then 'JPG'
            when 'es' then 'EXE' else 'TXT' end as file_type
        from documents""",
    "e_stored_documents": """
        select document_id, upper(trim(related_entity)) as related_entity, entity_id, title,
          file_type from e_documents""",
    "e_holidays": """
        select * from (values (date '2025-01-01', 'New Year', 'Y'),
          (date '2025-04-07', 'Memorial Day', 'Y'), (date '2025-07-01', 'Independence Day', 'Y'),
          (date '2025-12-25', 'Christmas', 'Y'), (date '1998-05-05', 'One-off Holiday', 'N'))
          h(holiday_date, description, is_recurring)""",
    "e_audit": """
        select event_id as audit_id, 'user' || cast(user_id as varchar) as user_name,
          case event_type when 'signup' then 'INSERT' when 'click' then 'UPDATE'
            when 'error' then 'DELETE' when 'purchase' then 'PROCEDURE'
            else 'DELETE_ATTEMPT' end as action,
          case event_id % 5 when 0 then 'WILLS' when 1 then 'ASSETS' when 2 then 'USERS'
            when 3 then 'TRANSFER_LOGS' else 'DOCUMENTS' end as action_table,
          user_id as record_id, cast(null as varchar) as old_values, props as new_values,
          ts as timestamp,
          case when event_type = 'error' then 'ERROR' when value < 5 then 'WARNING'
            else 'SUCCESS' end as status
        from events""",
    "e_changes": """
        select event_id as seq, user_id as will_id,
          case cast(regexp_extract(props, '[0-9]+', 0) as int) % 4 when 0 then 'Draft'
            when 1 then 'Approved' when 2 then 'Executing' else 'Executed' end as new_status,
          ts as change_date
        from events""",
    "e_signups": f"""
        select c_custkey as seq, case when c_custkey % 23 = 0 then '  ' else c_name end
            as full_name,
          case when c_custkey % 2 = 0 then {email('c_custkey')}
               else {email('(10000000 + c_custkey // 4)')} end as email,
          case when c_custkey % 29 = 0 then 'guest' else 'testator' end as initial_role
        from customer""",
    "e_approvals": f"""
        select {SEQ} as seq,
          case when l_partkey % 50 = 0 then -l_orderkey - 1 else l_orderkey end as will_id
        from lineitem""",
    "e_primary_requests": f"""
        select {SEQ} as seq,
          case when l_partkey % 100 <> 0 then l_orderkey * 10 + l_linenumber % 3 end
            as executor_id
        from lineitem""",
    "e_deletions": """
        select o_orderkey * 2 + i as seq, case when o_orderkey % 97 = 0 then null when o_orderkey % 89 = 0
            then -o_orderkey - 1 else o_orderkey end as will_id,
          (o_orderkey + i) % 3 = 0 as force,
          case when (o_orderkey + i) % 6 = 0 then 'DELETE-CONFIRM' end as confirm_text
        from orders cross join (values (0), (1)) t(i)
        where i = 0 or o_orderpriority = '1-URGENT'""",
    "e_share_changes": f"""
        select {ASSET} + case when l_partkey % 20 = 0 then 9 else 0 end as asset_id,
          l_suppkey as beneficiary_id, l_shipdate as changed_at from lineitem""",
    # Derived relations used by several statements.
    "v_allocated": """
        select a.asset_id, a.will_id, a.value, a.name, a.asset_type,
          coalesce((select sum(s.share_percent) from e_shares s where s.asset_id = a.asset_id), 0)
            as allocated,
          (select count(*) from e_shares s where s.asset_id = a.asset_id) as heirs
        from e_assets a""",
    "v_flags": """
        select u.*, exists (select 1 from e_wills w where w.user_id = u.user_id) as owns,
          exists (select 1 from e_executors x where x.email = u.email) as executes,
          exists (select 1 from e_beneficiaries b where b.email = u.email) as inherits
        from e_users u""",
    "v_portfolio": f"""
        select b.email, a.name, a.asset_type, a.value, s.share_percent, {WORTH} as my_share_value,
          w.title as will_title, w.status as will_status,
          case when t.transfer_id is not null then t.transfer_status
               else 'Not Transferred' end as transfer_status,
          case when t.transfer_status = 'Completed' then 'Transfer Completed'
               when t.transfer_status = 'Initiated' then 'Transfer in Progress'
               when w.status = 'Executed' then 'Awaiting Transfer'
               else 'Will Not Yet Executed' end as next_action
        from e_shares s join e_assets a on s.asset_id = a.asset_id
          join e_beneficiaries b on s.beneficiary_id = b.beneficiary_id
          join e_wills w on a.will_id = w.will_id
          left join e_transfers t on t.asset_id = a.asset_id
            and t.beneficiary_id = b.beneficiary_id""",
    "v_report": f"""
        select t.transfer_id, a.name as asset_name, b.full_name as beneficiary_name,
          t.transfer_date, t.transfer_status, t.approved_by, a.value, s.share_percent,
          {WORTH} as transfer_value, a.will_id
        from e_transfers t join e_assets a on t.asset_id = a.asset_id
          join e_beneficiaries b on t.beneficiary_id = b.beneficiary_id
          left join e_shares s on s.asset_id = t.asset_id
            and s.beneficiary_id = t.beneficiary_id""",
    "v_visible": """
        select user_id, will_id from e_wills where user_id in (select user_id from e_users)
        union
        select u.user_id, x.will_id from e_executors x join e_users u on x.email = u.email""",
    "v_low": """
        select w.will_id,
          (select count(*) from v_allocated a where a.will_id = w.will_id and 90 > a.allocated)
            as low90,
          (select count(*) from v_allocated a where a.will_id = w.will_id and 100 > a.allocated)
            as low100
        from e_wills w""",
    "v_approvals": """
        select r.seq, r.will_id, w.status,
          case when w.will_id is null then -20091 when w.status <> 'Draft' then -20092
            when x.n is null then -20093 when x.p = 0 then -20094
            when l.low90 > 0 then -20095 end as code,
          case when w.will_id is null then 'unknown will ' || cast(r.will_id as varchar)
            when w.status <> 'Draft' then 'will is ' || w.status
            when x.n is null then 'will has no executor'
            when x.p = 0 then 'will has no primary executor'
            when l.low90 > 0 then cast(l.low90 as varchar) || ' assets below 90 %' end as reason
        from e_approvals r left join e_wills w on r.will_id = w.will_id
          left join v_low l on l.will_id = r.will_id
          left join (select will_id, count(*) as n,
              sum(case when is_primary = 'Y' then 1 else 0 end) as p
            from e_executors group by will_id) x on x.will_id = r.will_id""",
    "v_approve": """
        select seq, will_id,
          case when code is null and seq <> first then -20092 else code end as code,
          case when code is null and seq <> first then 'will is Approved' else reason end
            as reason
        from (select *, min(seq) over (partition by will_id, code is null) as first
              from v_approvals)""",
    # Copies of a request are told apart by rid.
    "v_assign": """
        select r.*, row_number() over () as rid, a.will_id,
          case when r.share_percent is null or r.share_percent < 0.01 or r.share_percent > 100
              then 5
            when r.asset_id is null then -20010 when a.asset_id is null then -21001
            when b.beneficiary_id is null then -21002 when w.will_id is null then -20013
            when w.status = 'Executed' then -21003 end as code,
          case when r.share_percent is null or r.share_percent < 0.01 or r.share_percent > 100
              then 'share must lie between 0.01 and 100'
            when r.asset_id is null then 'asset id is missing'
            when a.asset_id is null then 'unknown asset ' || cast(r.asset_id as varchar)
            when b.beneficiary_id is null
              then 'unknown beneficiary ' || cast(r.beneficiary_id as varchar)
            when w.will_id is null then 'asset has no valid will'
            when w.status = 'Executed' then 'will is executed' end as reason,
          coalesce((select sum(share_percent) from e_shares s where s.asset_id = r.asset_id), 0)
            as stored
        from e_requests r left join e_assets a on r.asset_id = a.asset_id
          left join e_wills w on a.will_id = w.will_id
          left join e_beneficiaries b on b.beneficiary_id = r.beneficiary_id""",
    # Greedy acceptance, one request of every asset per step.
    "v_queue": """
        select *, row_number() over (partition by asset_id order by seq, rid) as place
        from v_assign where code is null""",
    "v_greedy": """
        select asset_id, place, rid, stored + case when stored + share_percent <= 100
            then share_percent else 0 end as used,
          stored + share_percent <= 100 as taken
        from v_queue where place = 1
        union all
        select q.asset_id, q.place, q.rid,
          g.used + case when g.used + q.share_percent <= 100 then q.share_percent else 0 end,
          g.used + q.share_percent <= 100
        from v_greedy g join v_queue q on q.asset_id = g.asset_id and q.place = g.place + 1""",
    "v_assigned": """
        select v.*, coalesce(g.taken, false) as taken,
          case when v.code is not null then v.code when not g.taken then -21004 end as final,
          case when v.code is not null then v.reason
            when not g.taken then 'shares would exceed 100 %' end as final_reason
        from v_assign v left join v_greedy g on g.rid = v.rid""",
    "v_transfer_checks": """
        select r.seq, r.asset_id, r.beneficiary_id, r.transfer_date, r.share_percent, a.will_id,
          w.status as will_status,
          case when a.asset_id is null then -23001 when b.beneficiary_id is null then -23002
            when not exists (select 1 from e_shares s where s.asset_id = r.asset_id
              and s.beneficiary_id = r.beneficiary_id) then -23003
            when w.status is null or w.status not in ('Approved', 'Executing') then -23004
            when exists (select 1 from e_transfers t where t.asset_id = r.asset_id
              and t.beneficiary_id = r.beneficiary_id and t.transfer_status = 'Completed')
              then -23005 end as code
        from e_requests r left join e_assets a on r.asset_id = a.asset_id
          left join e_wills w on w.will_id = a.will_id
          left join e_beneficiaries b on b.beneficiary_id = r.beneficiary_id""",
    "v_transfer_reasons": """
        select *, case code when -23001 then 'unknown asset ' || cast(asset_id as varchar)
            when -23002 then 'unknown beneficiary ' || cast(beneficiary_id as varchar)
            when -23003 then 'beneficiary has no share of the asset'
            when -23004 then 'will is ' || will_status
            when -23005 then 'transfer is completed already' end as reason
        from v_transfer_checks""",
    "v_calendar": """
        select r.*, case when dayofweek(transfer_date) in (0, 6) then -20001
            when h.hits > 0 then -20002 end as day_code,
          case when dayofweek(transfer_date) in (0, 6)
              then 'Weekend: no transfers on ' || dayname(transfer_date)
            when h.hits > 0 then 'Holiday: no transfers on ' || h.name || ' ('
              || upper(strftime(transfer_date, '%d-%b-%Y')) || ')' end as day_reason
        from v_transfer_reasons r left join (
            select d, count(*) as hits, max(description) as name
            from (select distinct transfer_date as d from e_requests) join e_holidays
              on holiday_date = cast(d as date)
              or (is_recurring = 'Y' and strftime(holiday_date, '%m-%d') = strftime(d, '%m-%d'))
            group by d) h on h.d = r.transfer_date""",
    "v_transfer": """
        select v.*, coalesce(code, day_code,
            case when will_status = 'Approved' and low100 > 0 then -20020 end) as final,
          case when code is not null then reason when day_code is not null then day_reason
            when will_status = 'Approved' and low100 > 0
              then cast(low100 as varchar) || ' assets below 100 %' end as final_reason
        from v_calendar v left join v_low l on l.will_id = v.will_id""",
    "v_documents": """
        select d.*, upper(trim(related_entity)) as kind,
          case when upper(trim(related_entity)) not in ('WILL', 'ASSET') then -24001
            when upper(trim(related_entity)) = 'WILL'
              and entity_id not in (select will_id from e_wills) then -24002
            when upper(trim(related_entity)) = 'ASSET'
              and entity_id not in (select asset_id from e_assets) then -24002 end as code
        from e_documents d""",
    "v_document_reasons": """
        select *, case code when -24001 then 'unusable related entity: ' || related_entity
            when -24002 then 'unknown ' || kind || ' ' || cast(entity_id as varchar) end as reason
        from v_documents""",
    "v_primary": """
        select r.seq, r.executor_id, x.will_id,
          case when r.executor_id is null then -25000 when x.executor_id is null then -25001 end
            as code,
          case when r.executor_id is null then 'executor id is missing'
            when x.executor_id is null then 'unknown executor ' || cast(r.executor_id as varchar)
            end as reason
        from e_primary_requests r left join e_executors x on x.executor_id = r.executor_id""",
    "v_chosen": """
        select will_id, arg_max(executor_id, seq) as chosen,
          (select min(executor_id) from e_executors x where x.will_id = p.will_id
            and is_primary = 'Y') as old,
          (select count(*) from e_executors x where x.will_id = p.will_id
            and is_primary = 'Y') as primaries
        from v_primary p where code is null group by will_id""",
    "v_deletions": deletions(protected=False),
    "v_deletions_protected": deletions(protected=True),
    "v_doomed": "select will_id, status as old_status from v_deletions where code is null",
    "v_gone_assets": "select asset_id, will_id from e_assets where will_id in (select will_id from v_doomed)",
    "v_deleted": """
        select will_id, 'documents' as part, count(*) as n from (
            select entity_id as will_id from e_stored_documents where related_entity = 'WILL'
              and entity_id in (select will_id from v_doomed)
            union all
            select g.will_id from e_stored_documents d join v_gone_assets g
              on d.related_entity = 'ASSET' and d.entity_id = g.asset_id) group by will_id
        union all select g.will_id, 'shares', count(*) from e_shares s join v_gone_assets g
          on s.asset_id = g.asset_id group by g.will_id
        union all select g.will_id, 'transfers', count(*) from e_transfers s join v_gone_assets g
          on s.asset_id = g.asset_id group by g.will_id
        union all select will_id, 'executors', count(*) from e_executors
          where will_id in (select will_id from v_doomed) group by will_id
        union all select will_id, 'assets', count(*) from v_gone_assets group by will_id
        union all select will_id, 'history', count(*) from e_changes
          where will_id in (select will_id from v_doomed) group by will_id
        union all select will_id, 'wills', 1 from v_doomed""",
    "v_related": """
        select d.will_id, d.old_status, r.* exclude (will_id)
        from v_doomed d join (
          select will_id, coalesce(sum(n) filter (part = 'assets'), 0) as assets,
            coalesce(sum(n) filter (part = 'executors'), 0) as executors,
            coalesce(sum(n) filter (part = 'shares'), 0) as shares,
            coalesce(sum(n) filter (part = 'documents'), 0) as documents, sum(n) as everything
          from v_deleted group by will_id) r on r.will_id = d.will_id""",
    # Replay of status changes, one change of every will per step.
    "v_steps": """
        select *, row_number() over (partition by will_id order by seq) as step from e_changes""",
    "v_replay": """
        select will_id, step, seq, new_status, change_date, cast(null as varchar) as old_status,
          cast(null as int) as code, new_status as status
        from v_steps where step = 1
        union all
        select s.will_id, s.step, s.seq, s.new_status, s.change_date, r.status,
          case when r.status = s.new_status then null when r.status = 'Executed' then -20003
            when r.status = 'Draft' and s.new_status = 'Executing' then -20004 end,
          case when r.status = 'Executed' or (r.status = 'Draft' and s.new_status = 'Executing')
            then r.status else s.new_status end
        from v_replay r join v_steps s on s.will_id = r.will_id and s.step = r.step + 1""",
}


def statement(body: str) -> str:
    """The body with the views it needs in front, in order of dependence."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[ev]_[a-z0-9_]+\b", sql):
            if name in VIEWS and name not in needed:
                if name in ("v_greedy", "v_replay"):
                    # Names itself; its other views come first.
                    visit(VIEWS[name].replace(name, ""))
                else:
                    visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    # Views that are used more than once are computed once.
    parts = ",\n".join(
        f"{n} as {'' if n in ('v_greedy', 'v_replay') else 'materialized '}({VIEWS[n].strip()})"
        for n in needed
    )
    return f"with recursive {parts}\n{body.strip()}" if needed else body.strip()


ORACLES: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    ORACLES[name] = statement(body)


def dbl(expression: str, name: str | None = None) -> str:
    return f"cast({expression} as double) as {name or expression.split('.')[-1]}"


def stamp(expression: str, name: str | None = None) -> str:
    shown = name or expression.split(".")[-1]
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') as {shown}"


def big(expression: str, name: str) -> str:
    return f"cast({expression} as bigint) as {name}"


# --- reports ---------------------------------------------------------------------------------

oracle(
    "q01_user_lookup",
    """select user_id, full_name, email from e_users
       where email in (select email from e_beneficiaries)""",
)
oracle(
    "q02_primary_role",
    """select user_id, case when initial_role = 'admin' then 'admin' when owns then 'testator'
         when executes then 'executor' when inherits then 'beneficiary'
         else coalesce(initial_role, 'user') end as role from v_flags""",
)
ROLES = """coalesce(nullif(concat_ws(',', case when initial_role = 'admin' then 'admin' end,
    case when owns then 'testator' end, case when executes then 'executor' end,
    case when inherits then 'beneficiary' end), ''), initial_role, 'user')"""
oracle("q03_all_roles", f"select user_id, {ROLES} as roles from v_flags")
oracle(
    "q04_testator_dashboard",
    f"""select u.user_id,
          (select count(*) from e_wills w where w.user_id = u.user_id) as total_wills,
          (select count(*) from e_assets a join e_wills w on a.will_id = w.will_id
            where w.user_id = u.user_id) as total_assets,
          {dbl('''coalesce((select sum(value) from e_assets a join e_wills w
            on a.will_id = w.will_id where w.user_id = u.user_id), 0)''', 'total_assets_value')},
          (select count(*) from e_wills w where w.user_id = u.user_id and status = 'Draft')
            as pending_wills,
          (select count(distinct s.beneficiary_id) from e_shares s
            join e_assets a on s.asset_id = a.asset_id join e_wills w on a.will_id = w.will_id
            where w.user_id = u.user_id) as total_beneficiaries
        from e_users u""",
)
oracle(
    "q05_executor_dashboard",
    """select x.email, count(distinct x.executor_id) as assigned_wills,
         count(case when t.transfer_status = 'Initiated' then 1 end) as pending_transfers,
         count(case when t.transfer_status = 'Completed' then 1 end) as completed_transfers
       from e_executors x left join e_assets a on a.will_id = x.will_id
         left join e_transfers t on t.asset_id = a.asset_id group by x.email""",
)
oracle(
    "q06_beneficiary_dashboard",
    f"""select b.email, count(s.asset_id) as assigned_assets,
          {dbl(f'coalesce(sum({WORTH}), 0)', 'total_value')}
        from e_beneficiaries b left join (select * from e_shares join e_assets using (asset_id)) s
          on s.beneficiary_id = b.beneficiary_id group by b.email""",
)
oracle(
    "q07_admin_totals",
    """select (select count(*) from e_users) as total_users,
         (select count(*) from e_wills) as total_wills,
         (select count(*) from e_assets) as total_assets,
         (select count(*) from e_transfers) as total_transfers""",
)
WILL_LIST = f"""w.will_id, w.user_id, w.title, w.description, w.status,
    {stamp('w.created_at')},
    (select count(*) from e_assets a where a.will_id = w.will_id) as asset_count,
    (select count(*) from e_executors x where x.will_id = w.will_id) as executor_count"""
oracle("q08_will_list", f"select {WILL_LIST} from e_wills w")
oracle(
    "q09_executor_will_list",
    f"""select distinct e.email, {WILL_LIST}
        from e_wills w join e_executors e on e.will_id = w.will_id""",
)
oracle(
    "q10_will_detail",
    f"""select w.will_id, w.user_id, w.title, w.description, w.status, {stamp('w.created_at')},
          {stamp('w.last_updated_at')}, u.full_name as owner_name, u.email as owner_email
        from e_wills w join e_users u on w.user_id = u.user_id""",
)
oracle(
    "q11_will_visibility",
    """select user_id, 'every will' as scope, cast(null as bigint) as will_id
       from e_users where initial_role = 'admin'
       union all select user_id, 'one will', will_id from v_visible""",
)
oracle(
    "q11_may_view",
    """select w.user_id, w.will_id + 1 as will_id,
         (coalesce(u.initial_role, '') = 'admin' or exists (select 1 from v_visible v
            where v.user_id = w.user_id and v.will_id = w.will_id + 1)) as allowed
       from e_wills w left join e_users u on u.user_id = w.user_id""",
)
oracle(
    "q12_asset_allocation",
    f"""select asset_id, will_id, name, asset_type, {dbl('value')},
          {dbl('allocated', 'allocated_percent')} from v_allocated""",
)
oracle(
    "q13_executors_ranked",
    "select will_id, executor_id, full_name, email, is_primary from e_executors",
)
oracle(
    "q14_allocation_detail",
    f"""select a.will_id, a.name as asset_name, b.full_name as beneficiary_name,
          {dbl('s.share_percent')}, {dbl(WORTH, 'estimated_value')}
        from e_shares s join e_assets a on s.asset_id = a.asset_id
          join e_beneficiaries b on s.beneficiary_id = b.beneficiary_id""",
)
oracle(
    "q15_remaining_percent",
    f"""select asset_id, {dbl('allocated', 'allocated_percent')},
          {dbl('100 - allocated', 'remaining_percent')} from v_allocated""",
)
oracle(
    "q16_current_allocations",
    f"""select s.asset_id, b.full_name, {dbl('s.share_percent')}, {dbl(WORTH, 'estimated_value')}
        from e_shares s join e_assets a on s.asset_id = a.asset_id
          join e_beneficiaries b on s.beneficiary_id = b.beneficiary_id""",
)
oracle(
    "q17_beneficiary_inheritance",
    f"""select b.beneficiary_id, b.full_name, b.relation, b.email,
          count(s.asset_id) as assigned_assets,
          {dbl(f'coalesce(sum({WORTH}), 0)', 'total_inheritance')}
        from e_beneficiaries b left join e_shares s on b.beneficiary_id = s.beneficiary_id
          left join e_assets a on s.asset_id = a.asset_id
        group by b.beneficiary_id, b.full_name, b.relation, b.email""",
)
REPORT_COLUMNS = f"""transfer_id, asset_name, beneficiary_name, {stamp('transfer_date')},
    transfer_status, approved_by, {dbl('value')}, {dbl('share_percent')},
    {dbl('transfer_value')}"""
oracle("q18_transfer_report", f"select {REPORT_COLUMNS} from v_report")
oracle(
    "q19_transfer_report_scoped",
    f"""select distinct {REPORT_COLUMNS} from v_report r
          join e_wills w on w.will_id = r.will_id
          left join e_executors x on x.will_id = w.will_id
        where x.email = {email('7')} or w.user_id = 7""",
)
oracle(
    "q19_viewer_transfer_totals",
    f"""select v.user_id, count(*) as total,
          {big("sum(case when transfer_status = 'Initiated' then 1 else 0 end)", 'pending')},
          {big("sum(case when transfer_status = 'Completed' then 1 else 0 end)", 'completed')},
          {dbl('coalesce(sum(transfer_value), 0)', 'total_value')}
        from v_report r join e_wills w on w.will_id = r.will_id
          join v_visible v on v.will_id = r.will_id group by v.user_id""",
)
oracle(
    "q20_eligible_beneficiaries",
    f"""select a.asset_id, a.name, {dbl('coalesce(a.value, 0)', 'value')}, a.asset_type,
          h.full_name, h.beneficiary_id as id, h.relation, {dbl('h.share_percent')}
        from e_assets a left join (
          select s.asset_id, s.share_percent, b.* from e_shares s
            join e_beneficiaries b on b.beneficiary_id = s.beneficiary_id) h
          on h.asset_id = a.asset_id""",
)
oracle(
    "q21_beneficiary_portfolio",
    f"""select email, name, asset_type, {dbl('value')}, {dbl('share_percent')},
          {dbl('my_share_value')}, will_title, will_status, transfer_status, next_action
        from v_portfolio""",
)
oracle(
    "q22_will_summary_exact",
    f"""select a.will_id, count(*) as total_assets, {dbl('sum(a.value)', 'total_value')},
          (select count(distinct s.beneficiary_id) from e_shares s join e_assets b
            on s.asset_id = b.asset_id where b.will_id = a.will_id) as total_beneficiaries,
          (select count(*) from e_executors x where x.will_id = a.will_id) as total_executors,
          (select count(*) from e_executors x where x.will_id = a.will_id
            and x.is_primary = 'Y') as primary_executors,
          round_even(cast(sum(a.value) as double) / count(*), 0) as avg_asset_value
        from e_assets a group by a.will_id""",
)
oracle(
    "q22_will_summary_as_written",
    f"""select a.will_id, count(a.asset_id) as total_assets,
          {dbl('coalesce(sum(a.value), 0)', 'total_value')},
          count(distinct s.beneficiary_id) as total_beneficiaries,
          count(x.executor_id) as total_executors,
          count(case when x.is_primary = 'Y' then 1 end) as primary_executors,
          round_even(cast(sum(a.value) as double) / count(a.asset_id), 0) as avg_asset_value
        from e_assets a left join e_shares s on a.asset_id = s.asset_id
          left join e_executors x on a.will_id = x.will_id group by a.will_id""",
)
BAND = """case when allocated >= 100 then 'Fully Allocated' when allocated >= 80
    then 'Nearly Complete' else 'Incomplete' end"""
oracle(
    "q23_will_asset_allocations",
    f"""select will_id, asset_id, name, asset_type, {dbl('value')},
          {dbl('allocated', 'allocated_percent')}, heirs as beneficiary_count, {BAND} as band
        from v_allocated""",
)
oracle(
    "q24_will_beneficiary_summary",
    f"""select will_id, beneficiary_id, full_name, relation, assigned_assets,
          {dbl('total', 'total_inheritance')},
          coalesce(cast(total as double)
            / nullif(cast(sum(total) over (partition by will_id) as double), 0) * 100, 0)
            as pct_of_estate
        from (select a.will_id, b.beneficiary_id, b.full_name, b.relation,
                count(s.asset_id) as assigned_assets, coalesce(sum({WORTH}), 0) as total
              from e_beneficiaries b join e_shares s on b.beneficiary_id = s.beneficiary_id
                join e_assets a on s.asset_id = a.asset_id
              group by a.will_id, b.beneficiary_id, b.full_name, b.relation)""",
)
oracle(
    "q25_system_totals",
    f"""select (select count(*) from e_users) as total_users,
         (select count(*) from e_wills) as total_wills,
         (select count(*) from e_assets) as total_assets,
         (select count(*) from e_beneficiaries) as total_beneficiaries,
         (select count(*) from e_executors) as total_executors,
         (select count(*) from e_transfers) as total_transfers,
         {dbl('coalesce((select sum(value) from e_assets), 0)', 'total_asset_value')}""",
)
oracle(
    "q26_will_status_distribution",
    """select status, count(*) as count,
         cast(count(*) as double) / cast(sum(count(*)) over () as double) * 100 as percentage
       from e_wills group by status""",
)
oracle(
    "q27_recent_activity",
    f"""select activity, description, {stamp('activity_date')} from (
          select 'Will Created' as activity, title as description, created_at as activity_date,
            will_id as tie
          from e_wills where created_at >= {REPORT} - interval 30 day
          union all
          select 'Transfer Initiated', a.name || ' to ' || b.full_name, t.transfer_date,
            t.transfer_id
          from e_transfers t join e_assets a on t.asset_id = a.asset_id
            join e_beneficiaries b on t.beneficiary_id = b.beneficiary_id
          where t.transfer_date >= {REPORT} - interval 30 day)
        order by activity_date desc, activity desc, tie desc limit 20""",
)
AUDIT_ROW = f"""audit_id, user_name, action, action_table, record_id, old_values, new_values,
    {stamp('timestamp')}, status"""
oracle(
    "q28_audit_page",
    f"""select {AUDIT_ROW}, cast(rn as int) as rn, total, total > 150 as has_next,
          true as has_prev
        from (select *, row_number() over (order by timestamp desc, audit_id desc) as rn,
                count(*) over () as total from e_audit) where rn > 100 and rn <= 150""",
)
oracle(
    "q28_audit_page_facets",
    f"""select {AUDIT_ROW}, cast(rn as int) as rn, total, total > 50 as has_next,
          false as has_prev
        from (select *, row_number() over (order by timestamp desc, audit_id desc) as rn,
                count(*) over () as total from e_audit
              where action = 'UPDATE' and action_table = 'WILLS' and status = 'SUCCESS'
                and cast(timestamp as date) = date '2024-01-15') where rn <= 50""",
)
oracle(
    "q28_audit_next_page",
    f"""select {AUDIT_ROW} from e_audit
        where timestamp < timestamp '2024-01-16 00:00:00'
          or (timestamp = timestamp '2024-01-16 00:00:00' and audit_id < 1000000000000)
        order by e_audit.timestamp desc, audit_id desc limit 50""",
)
oracle(
    "q29_user_activity",
    f"""select user_id, full_name, email, initial_role, {stamp('created_at')},
          (select count(*) from e_wills w where w.user_id = u.user_id) as wills_count,
          (select count(*) from e_executors x where x.email = u.email) as executor_count,
          (select count(*) from e_beneficiaries b where b.email = u.email) as beneficiary_count
        from e_users u""",
)
oracle(
    "q30_role_counts",
    """select count(*) as total, count(*) filter (initial_role = 'testator') as testators,
         count(*) filter (initial_role = 'executor') as executors,
         count(*) filter (initial_role = 'beneficiary') as beneficiaries from e_users""",
)
oracle(
    "q31_will_stats_exact",
    f"""select a.will_id, count(*) as total_assets, {dbl('sum(a.value)', 'total_value')},
          (select count(distinct s.beneficiary_id) from e_shares s join e_assets b
            on s.asset_id = b.asset_id where b.will_id = a.will_id) as total_beneficiaries,
          (select cast(sum(coalesce(s.share_percent, 0)) as double) / count(*) from e_assets b
            left join e_shares s on s.asset_id = b.asset_id where b.will_id = a.will_id)
            as avg_allocation
        from e_assets a group by a.will_id""",
)
oracle(
    "q31_will_stats_as_written",
    f"""select a.will_id, count(a.asset_id) as total_assets,
          {dbl('coalesce(sum(a.value), 0)', 'total_value')},
          count(distinct s.beneficiary_id) as total_beneficiaries,
          cast(sum(coalesce(s.share_percent, 0)) as double) / count(*) as avg_allocation
        from e_assets a left join e_shares s on a.asset_id = s.asset_id group by a.will_id""",
)
oracle(
    "q32_beneficiary_assets",
    f"""select s.beneficiary_id, a.asset_id, a.name, a.asset_type, {dbl('a.value')},
          {dbl('s.share_percent')}, {dbl(WORTH, 'inheritance_value')}
        from e_shares s join e_assets a on s.asset_id = a.asset_id""",
)
oracle(
    "q33_calendar_status",
    """select strftime(d, '%Y-%m-%d') as d, cast(dayofweek(d) + 1 as int) as day_number,
         dayname(d) as day_name, upper(strftime(d, '%d-%b-%Y')) as date_text,
         dayofweek(d) in (0, 6) as is_weekend,
         case when dayofweek(d) in (0, 6) then 'Weekend transfers blocked'
           else 'Weekday transfers allowed' end as status
       from (select distinct cast(o_orderdate as date) as d from orders)""",
)
oracle(
    "q34_executor_counts",
    """select w.will_id, w.title, count(x.executor_id) as executor_count
       from e_wills w left join e_executors x on w.will_id = x.will_id
       group by w.will_id, w.title""",
)
oracle(
    "q35_will_executors",
    """select w.will_id, w.title, w.status, x.executor_id, x.full_name, x.email, x.is_primary
       from e_wills w left join e_executors x on w.will_id = x.will_id""",
)
oracle(
    "q36_wills_with_testator",
    """select w.will_id, w.title, w.status, u.full_name as testator_name
       from e_wills w join e_users u on w.user_id = u.user_id""",
)
oracle(
    "q37_allocation_listing",
    f"""select a.name as asset_name, b.full_name as beneficiary_name, {dbl('s.share_percent')}
        from e_shares s join e_assets a on s.asset_id = a.asset_id
          join e_beneficiaries b on s.beneficiary_id = b.beneficiary_id""",
)
oracle(
    "q38_will_value",
    f"""select w.will_id, w.title, w.status, count(a.asset_id) as asset_count,
          {dbl('sum(a.value)', 'total_value')}
        from e_wills w left join e_assets a on a.will_id = w.will_id
        group by w.will_id, w.title, w.status""",
)
oracle(
    "q39_audit_trail",
    f"""select user_name, action, action_table, {stamp('timestamp')}, status from e_audit
        where timestamp >= {AUDIT} - interval 7 day""",
)
oracle(
    "q40_audit_action_counts",
    f"""select action, count(*) as count from e_audit
        where timestamp >= {AUDIT} - interval 7 day group by action""",
)
oracle("q40_audit_status_counts", "select status, count(*) as count from e_audit group by status")
oracle(
    "q41_transfer_totals",
    f"""select count(*) as total, count(*) filter (transfer_status = 'Initiated') as pending,
          count(*) filter (transfer_status = 'Completed') as completed,
          {dbl('coalesce(sum(transfer_value), 0)', 'total_value')} from v_report""",
)
oracle(
    "q42_portfolio_totals",
    f"""select email, count(*) as assets, {dbl('sum(my_share_value)', 'total_value')},
          count(*) filter (transfer_status = 'Initiated') as initiated,
          count(*) filter (transfer_status = 'Completed') as completed
        from v_portfolio group by email""",
)
oracle(
    "q43_allocation_bands",
    f"select {BAND} as band, count(*) as asset_count from v_allocated group by 1",
)
oracle("q44_users", "select user_id, full_name, email from e_users")
oracle("q44_wills", "select will_id, title, status, user_id from e_wills")
oracle("q44_assets", f"select asset_id, will_id, name, asset_type, {dbl('value')} from e_assets")
oracle("q44_beneficiaries", "select beneficiary_id, full_name, relation, email from e_beneficiaries")
oracle("q44_executors", "select executor_id, will_id, full_name, email, is_primary from e_executors")

# --- building blocks -------------------------------------------------------------------------

oracle("s2_one_row", "select count(*) as drafts from e_wills where status = 'Draft'")
oracle(
    "s3_literal_rows",
    """select strftime(holiday_date, '%Y-%m-%d') as holiday_date, description, is_recurring,
         count(*) as requests
       from e_requests join e_holidays on cast(transfer_date as date) = holiday_date
       group by holiday_date, description, is_recurring""",
)
NEW_USERS = """select *, case when trim(full_name) = '' or coalesce(trim(email), '') = ''
      or coalesce(trim(initial_role), '') = '' then 1
    when initial_role not in ('testator','executor','beneficiary','admin','user') then 4
    when email in (select email from e_users where email is not null) then 2 end as early
  from e_signups"""
SIGNUPS = f"""select seq, full_name, email, initial_role,
    case when early is not null then early
      when seq <> min(seq) over (partition by email, early in (1, 4) and early is not null)
        then 3 end as code
  from ({NEW_USERS})"""
oracle(
    "s4_append_accepted",
    f"select seq, full_name, email, initial_role from ({SIGNUPS}) where code is null",
)
oracle(
    "s5_json_rows",
    """select cast(json_object('beneficiary_id', s.beneficiary_id, 'asset_id', a.asset_id,
         'name', a.name, 'asset_type', a.asset_type,
         'share_percent', cast(s.share_percent as varchar)) as varchar) as json
       from e_shares s join e_assets a on s.asset_id = a.asset_id""",
)
oracle(
    "s6_csv_export",
    f"""select audit_id, user_name, action, action_table, record_id, old_values, new_values,
         {stamp('timestamp')}, status from e_audit""",
)
oracle(
    "p13_facet_filter",
    """select audit_id, action, status, user_name from e_audit
       where action = 'DELETE' and status = 'ERROR' and user_name = 'user8'""",
)
oracle(
    "p14_text_search",
    """select user_id, address from e_users
       where contains(lower(concat_ws(' ', full_name, email, address)), 'street, kig')""",
)
oracle(
    "p15_transfer_tabs",
    """select 'pending' as tab, count(*) as rows from e_transfers
         where transfer_status = 'Initiated'
       union all select 'completed', count(*) from e_transfers
         where transfer_status = 'Completed'
       union all select 'all', count(*) from e_transfers""",
)
oracle(
    "p6_in_and_not_in",
    """select true as transferable, count(*) as wills from e_wills
         where status in ('Approved', 'Executing')
       union all select false, count(*) from e_wills
         where status not in ('Approved', 'Executing')""",
)
oracle(
    "p10_case_and_default",
    """select user_id, coalesce(initial_role, 'user') as role,
         case coalesce(initial_role, 'user') when 'admin' then 1 when 'testator' then 2
           when 'executor' then 2 else 3 end as rank from e_users""",
)
oracle(
    "p12_inequality",
    "select user_id, initial_role from e_users where initial_role <> 'admin'",
)
oracle(
    "p5_or_filter",
    """select document_id, related_entity, file_type from e_documents
       where related_entity = 'ASSET' or file_type = 'EXE'""",
)
oracle(
    "p3_bound_parameter",
    "select will_id, title from e_wills where status = 'Approved' and user_id >= 10",
)
oracle(
    "j6_semi_join",
    "select mapping_id from e_shares where asset_id in (select asset_id from e_transfers)",
)
oracle(
    "j8_anti_join",
    "select will_id, status from e_wills where will_id not in (select will_id from e_assets)",
)
oracle(
    "j9_scalar_per_row",
    f"""select w.will_id, {dbl('''(select max(a.value) from e_assets a
          where a.will_id = w.will_id)''', 'top_value')} from e_wills w""",
)
oracle("o4_distinct_rows", "select distinct email, is_primary from e_executors")
oracle(
    "o5_first_row",
    "select asset_id, beneficiary_id from e_shares order by mapping_id limit 1",
)
NUMBER = r"""try_cast(nullif(regexp_extract(regexp_replace({c}, '[^0-9.-]', '', 'g'),
    '^-?([0-9]+\.?[0-9]*|\.[0-9]+)', 0), '') as double)"""
oracle(
    "o6_display_sort",
    f"select user_id, phone_number, {NUMBER.format(c='phone_number')} as number from e_users",
)
oracle(
    "c_text",
    """select document_id, upper(trim(related_entity)) as entity,
         '/documents/' || lower(trim(related_entity)) || '_' || cast(entity_id as varchar) || '_'
           || replace(title, ' ', '_') || '.' || lower(file_type) as path,
         title || ' is ' || coalesce(nullif(file_type, 'EXE'), '') as joined,
         trim(substr(title, instr(title, ' ') + 1)) as tail
       from e_documents""",
)
oracle(
    "c_shorten",
    """select doc_id, case when length(text) > 50 then substr(text, 1, 50) || '…' else text end
         as short, cast(length(text) as int) as long from documents""",
)
DIGITS = "regexp_replace(phone_number, '[^0-9]', '', 'g')"
PHONE = f"case when {DIGITS} like '250%' then substr({DIGITS}, 1, 12) else {DIGITS} end"
AGE = """(year(timestamp '2025-06-11') - year(date_of_birth)
    - case when strftime(date_of_birth, '%m%d') > '0611' then 1 else 0 end)"""
oracle(
    "c_users",
    rf"""select user_id, case coalesce(initial_role, 'no_role') when 'no_role' then 'No Role'
           else upper(initial_role[1]) || initial_role[2:] end as role_title,
         {PHONE} as digits,
         regexp_matches({PHONE}, '^(\+?250|0)?7[2-9]\d{{7}}$') as phone_ok,
         regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,4}}$') as email_ok,
         {NUMBER.format(c='full_name')} as number, cast({AGE} as int) as age,
         cast(length(address) as int) as address_length
       from e_users""",
)
oracle(
    "c_dates",
    """select transfer_id, cast(dayofweek(transfer_date) + 1 as int) as day_number,
         dayname(transfer_date) as day_name, strftime(transfer_date, '%m-%d') as month_day,
         upper(strftime(transfer_date, '%d-%b-%Y')) as date_text,
         upper(strftime(transfer_date, '%d-%b-%Y %H:%M:%S')) as date_time,
         strftime(transfer_date, '%b %d, %Y') as short_date,
         strftime(transfer_date, '%m/%d/%Y') as slash_date,
         strftime(transfer_date, '%I:%M %p') as clock,
         strftime(transfer_date, '%Y-%m-%d') as day,
         strftime(transfer_date - interval 10 day, '%Y-%m-%d') as ten_before,
         isodow(transfer_date) >= 6 as weekend, strftime(transfer_date, '%Y-%m-%d') as parsed,
         cast(null as varchar) as unparsed
       from e_transfers""",
)
oracle(
    "c_money",
    f"""select asset_id, {dbl('100 - allocated', 'remaining')},
          {dbl('greatest(0, least(100, allocated))', 'clamped')}, {BAND} as band,
          {dbl('round_even(cast(allocated as double), 1)', 'one_decimal')},
          format('{{:,.2f}}', cast(value as double)) as amount,
          'RWF ' || format('{{:,.0f}}', floor(cast(value as double))) as francs,
          cast(cast(floor(value) as bigint) as varchar) as whole_text,
          cast(floor(value) as bigint) as whole
        from v_allocated""",
)
oracle(
    "c_roles",
    f"""select user_id, cast(len(r) as int) as how_many,
          list_contains(r, 'executor') or list_contains(r, 'admin') as may_transfer,
          list_contains(r, 'testator') as is_testator, r[1] as first_role
        from (select user_id, string_split({ROLES}, ',') as r from v_flags)""",
)
oracle(
    "c_json",
    """select audit_id, case audit_id % 3 when 0 then 'plain text' when 1 then '{broken'
           else cast(json(new_values) as varchar) end as new_shown,
         'No data' as old_shown,
         case when audit_id % 3 = 2 then json_extract_string(new_values, '$.k') end as k,
         cast(json_object('user', user_name, 'old', old_values) as varchar) as built
       from e_audit""",
)

# --- validators ------------------------------------------------------------------------------

oracle(
    "r01_email",
    r"""select user_id, email, case when bad then -20030 end as reject_code,
         case when bad then 'malformed e-mail: ' || email end as reject_reason
       from (select *, email is not null and not regexp_matches(email,
           '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,4}$') as bad from e_users)""",
)
oracle(
    "r02_new_users",
    f"""select seq, full_name, email, initial_role, code as reject_code,
          case code when 1 then 'name, e-mail and role are required'
            when 2 then 'e-mail is registered already' when 3 then 'e-mail repeats in the batch'
            when 4 then 'unknown role' end as reject_reason
        from ({SIGNUPS})""",
)
oracle(
    "r03_assignments",
    f"""select seq, asset_id, beneficiary_id, {stamp('transfer_date')}, {dbl('share_percent')},
          coalesce(code, over) as reject_code,
          case when code is not null then reason when over is not null
            then 'shares would exceed 100 %, now at '
              || cast(cast(stored as decimal(17,2)) as varchar) end as reject_reason,
          code is null and over is null and stored + share_percent < 90 as below_90
        from (select *, case when stored + share_percent > 100 then -21004 end as over
              from v_assign)""",
)
oracle(
    "r03_share_rows",
    f"""select mapping_id, asset_id, beneficiary_id, {dbl('share_percent')}, code as reject_code,
          case code when -20012 then 'will is executed'
            when -20005 then 'shares add up to ' || cast(cast(total as decimal(18,2)) as varchar)
            end as reject_reason
        from (select *, case when status = 'Executed' then -20012 when total > 100 then -20005
                end as code
              from (select s.mapping_id, s.asset_id, s.beneficiary_id,
                      s.share_percent + 1 as share_percent, w.status,
                      sum(s.share_percent) over (partition by s.asset_id) + 1 as total
                    from e_shares s join e_assets a on s.asset_id = a.asset_id
                      join e_wills w on w.will_id = a.will_id))""",
)
oracle(
    "r04_allocation_approve",
    """select will_id, low90 as incomplete, case when low90 > 0 then -20095 end as reject_code
       from v_low""",
)
oracle(
    "r04_allocation_execute",
    """select will_id, low100 as incomplete, case when low100 > 0 then -20020 end as reject_code,
         case when low100 > 0 then cast(low100 as varchar) || ' assets below 100 %' end
           as reject_reason from v_low""",
)
oracle(
    "r05_approvals",
    "select seq, will_id, code as reject_code, reason as reject_reason from v_approvals",
)
oracle(
    "r06_transfers",
    f"""select seq, asset_id, beneficiary_id, {stamp('transfer_date')}, {dbl('share_percent')},
          will_id, will_status, code as reject_code, reason as reject_reason
        from v_transfer_reasons""",
)
oracle(
    "r07_business_day",
    f"""select seq, asset_id, beneficiary_id, {stamp('transfer_date')}, {dbl('share_percent')},
          day_code as reject_code, day_reason as reject_reason from v_calendar""",
)
oracle(
    "r08_status_moves",
    """select c.seq, w.status as old_status, c.new_status,
         case when w.status = c.new_status then null when w.status = 'Executed' then -20003
           when w.status = 'Draft' and c.new_status = 'Executing' then -20004 end as reject_code,
         case when w.status = c.new_status then null
           when w.status = 'Executed' then 'executed will cannot become ' || c.new_status
           when w.status = 'Draft' and c.new_status = 'Executing'
             then 'draft will cannot become Executing' end as reject_reason
       from e_changes c join e_wills w on w.will_id = c.will_id""",
)
oracle(
    "r09_primary",
    """select executor_id, is_primary, case when is_primary = 'Y' and exists (
           select 1 from e_executors o where o.will_id = x.will_id and o.is_primary = 'Y'
             and o.executor_id <> x.executor_id) then -20022 end as reject_code
       from e_executors x""",
)
oracle(
    "r09_primary_in_batch",
    """select executor_id + 4 as executor_id, 'Y' as is_primary,
         case when exists (select 1 from e_executors o where o.will_id = x.will_id
             and (o.is_primary = 'Y' or o.executor_id < x.executor_id)) then -20022 end
           as reject_code
       from e_executors x""",
)
oracle(
    "r10_documents",
    """select document_id, related_entity, entity_id, title, file_type, code as reject_code,
         reason as reject_reason from v_document_reasons""",
)
oracle(
    "r11_deletions",
    """select seq, will_id, force, confirm_text, code as reject_code, reason as reject_reason
       from v_deletions_protected""",
)
oracle(
    "r11_deletions_unprotected",
    """select seq, will_id, force, confirm_text, code as reject_code, reason as reject_reason
       from v_deletions""",
)
DOMAINS = (
    ("e_users", "initial_role", "'testator','executor','beneficiary','admin','user'"),
    ("e_transfers", "transfer_status", "'Initiated','Completed','Failed'"),
    ("e_documents", "related_entity", "'WILL','ASSET'"),
    ("e_documents", "file_type", "'PDF','DOC','JPG','PNG','TXT'"),
    ("e_assets", "asset_type", KINDS.strip("[]")),
    ("e_wills", "status", "'Draft','Approved','Executing','Executed'"),
)
oracle(
    "r12_domains",
    "\nunion all ".join(
        f"""select '{c}' as column, {c} as value, count(*) as rows,
              coalesce({c} in ({allowed}), false) as in_domain from {view} group by {c}"""
        for view, c, allowed in DOMAINS
    ),
)
oracle(
    "r13_orphan_shares",
    f"""select asset_id, beneficiary_id, {stamp('changed_at')} from e_share_changes
        where asset_id not in (select asset_id from e_assets)""",
)
oracle(
    "r14_asset_forms",
    """select *, case when name is null or coalesce(trim(asset_type), '') = '' or trim(value) = ''
           then 1 when try_cast(trim(value) as decimal(15,2)) is null
             or try_cast(trim(value) as decimal(15,2)) < 0 then 6 end as reject_code,
         case when name is null then 'name is required'
           when trim(asset_type) = '' then 'asset type is required'
           when trim(value) = '' then 'value is required'
           when try_cast(trim(value) as decimal(15,2)) is null then 'value is no number'
           when try_cast(trim(value) as decimal(15,2)) < 0 then 'value is negative' end
           as reject_reason
       from (select p_partkey as seq, case when p_size % 10 <> 0 then p_name end as name,
         case when p_partkey % 31 = 0 then '' else p_type end as asset_type,
         case when p_partkey % 9 = 0 then 'abc' when p_partkey % 11 = 0 then '-5'
           when p_partkey % 14 = 0 then ' ' else cast(p_partkey as varchar) end as value
       from part)""",
)
PERSON = f"""(select c_custkey as seq, case when c_custkey % 10 <> 0 then c_name end as full_name,
    case when c_custkey % 7 = 0 then ' ' else 'Child' end as relation,
    case when c_custkey % 8 <> 0 then {email('c_custkey')} end as email from customer)"""
for entry, second in (("r14_beneficiary_forms", "relation"), ("r14_executor_forms", "email")):
    oracle(
        entry,
        f"""select *, case when full_name is null or coalesce(trim({second}), '') = '' then 1 end
              as reject_code,
              case when full_name is null then 'full name is required'
                when coalesce(trim({second}), '') = '' then '{second} is required' end
              as reject_reason from {PERSON}""",
    )
oracle(
    "r14_will_forms",
    """select *, case when trim(title) = '' then 1 end as reject_code,
         case when trim(title) = '' then 'title is required' end as reject_reason
       from (select o_orderkey as seq, case when o_orderkey % 12 = 0 then ' '
           else 'Will ' || cast(o_orderkey as varchar) end as title from orders)""",
)
oracle(
    "r15_explain",
    """select seq, asset_id, day_code as reject_code, day_reason as reject_reason,
         case day_code when -20001 then 'weekend' else 'holiday' end as error_class,
         'warning' as severity,
         case day_code when -20001 then 'Weekend restriction: '
           else 'Holiday restriction: ' end || trim(split_part(day_reason, ':', 2)) as message
       from v_calendar where day_code is not null""",
)
oracle(
    "r15_explain_approvals",
    """select seq, will_id, code as reject_code, reason as reject_reason,
         'approval' as error_class, 'danger' as severity,
         case code when -20091 then 'The will is unknown'
           when -20092 then 'Only drafts can be approved'
           when -20093 then 'The will has no executor'
           when -20094 then 'The will has no primary executor'
           else 'Some assets are allocated below 90 %' end || ': ' || reason as message
       from v_approvals where code is not null""",
)
oracle(
    "r16_primary_requests",
    "select seq, executor_id, will_id, code as reject_code, reason as reject_reason from v_primary",
)
oracle(
    "r17_profile",
    rf"""select user_id, code as reject_code, case code when 1 then 'name shorter than 3 characters'
          when 2 then 'unusable e-mail' when 3 then 'unusable phone number'
          when 4 then 'younger than 18' when 5 then 'address shorter than 10 characters' end
          as reject_reason
        from (select user_id, case when length(trim(full_name)) < 3 then 1
            when not regexp_matches(trim(email), '^[^\s@]+@[^\s@]+\.[^\s@]+$') then 2
            when not regexp_matches({PHONE}, '^(\+?250|0)?7[2-9]\d{{7}}$') then 3
            when {AGE} < 18 then 4 when length(trim(address)) < 10 then 5 end as code
          from e_users)""",
)

# --- transitions -----------------------------------------------------------------------------


def audit(action, table, record, old, new, status, source, when=REPORT_TEXT) -> str:
    return f"""select 'registrar' as user_name, {action} as action, {table} as action_table,
        cast({record} as bigint) as record_id, cast({old} as varchar) as old_values,
        cast({new} as varchar) as new_values, {when} as timestamp, {status} as status
        from {source}"""


def refused(table, record, step, code, reason, source) -> str:
    words = f"cast({code} as varchar) || ' ' || {reason}"
    return audit("'PROCEDURE'", f"'{table}'", record, f"'{step} refused'", words, "'ERROR'", source)


def wills_after(ids: str, status: str) -> str:
    return f"""select will_id, user_id, title, description,
        case when will_id in ({ids}) then '{status}' else status end as status,
        {stamp('created_at')},
        case when will_id in ({ids}) then {REPORT_TEXT}
          else strftime(last_updated_at, '%Y-%m-%d %H:%M:%S') end as last_updated_at
      from e_wills"""


APPROVED = "select will_id from v_approve where code is null"
oracle("m01_approve_wills", wills_after(APPROVED, "Approved"))
oracle(
    "m01_approve_history",
    f"""select distinct will_id, 'Draft' as old_status, 'Approved' as new_status,
          'registrar' as changed_by, {REPORT_TEXT} as change_date, 'approve_wills' as reason
        from v_approve where code is null""",
)
oracle(
    "m01_approve_audit",
    audit("'PROCEDURE'", "'WILLS'", "will_id", """'{"status":"Draft"}'""",
          """'{"status":"Approved"}'""", "'SUCCESS'", "v_approve where code is null")
    + " union all "
    + refused("WILLS", "will_id", "approve_wills", "code", "reason",
              "v_approve where code is not null"),
)
oracle(
    "m01_approve_rejected",
    """select seq, will_id, code as reject_code, reason as reject_reason from v_approve
       where code is not null""",
)
ADDED = f"""select cast(null as bigint) as mapping_id, asset_id, beneficiary_id,
    {dbl('share_percent')}, cast(null as varchar) as conditions from v_assigned where taken"""
oracle("m02_assign_added", ADDED)
oracle(
    "m02_assign_shares",
    f"""select mapping_id, asset_id, beneficiary_id, {dbl('share_percent')},
          cast(null as varchar) as conditions from e_shares union all {ADDED}""",
)
oracle(
    "m02_assign_audit",
    audit("'INSERT'", "'WILL_ASSET_BENEFICIARIES'", "null", "null",
          "'Share of asset ' || cast(asset_id as varchar) || ' for beneficiary #' "
          "|| cast(beneficiary_id as varchar)", "'SUCCESS'", "v_assigned where taken")
    + " union all "
    + refused("WILL_ASSET_BENEFICIARIES", "null", "assign_shares", "final", "final_reason",
              "v_assigned where final is not null"),
)
oracle(
    "m02_assign_rejected",
    f"""select seq, asset_id, beneficiary_id, {dbl('share_percent')}, final as reject_code,
          final_reason as reject_reason from v_assigned where final is not null""",
)
NEW_TRANSFERS = f"""select cast(null as bigint) as transfer_id, asset_id, beneficiary_id,
    {stamp('transfer_date')}, 'registrar' as approved_by, 'Initiated' as transfer_status,
    'Transfer initiated by registrar on '
      || upper(strftime(transfer_date, '%d-%b-%Y %H:%M:%S')) as notes
  from v_transfer where final is null"""
FLIPPED = "select will_id from v_transfer where final is null and will_status = 'Approved'"
oracle("m03_transfer_added", NEW_TRANSFERS)
oracle("m03_transfer_wills", wills_after(FLIPPED, "Executing"))
oracle(
    "m03_transfer_history",
    f"""select distinct will_id, 'Approved' as old_status, 'Executing' as new_status,
          'registrar' as changed_by, {REPORT_TEXT} as change_date, 'transfer_assets' as reason
        from v_transfer where final is null and will_status = 'Approved'""",
)
oracle(
    "m03_transfer_audit",
    audit("'INSERT'", "'TRANSFER_LOGS'", "null", "null",
          "'Transfer from asset ' || cast(asset_id as varchar) || ' to Beneficiary #' "
          "|| cast(beneficiary_id as varchar)", "'SUCCESS'", "v_transfer where final is null")
    + " union all "
    + refused("TRANSFER_LOGS", "null", "transfer_assets", "final", "final_reason",
              "v_transfer where final is not null"),
)
oracle(
    "m03_transfer_rejected",
    f"""select seq, asset_id, beneficiary_id, {stamp('transfer_date')}, will_id,
          final as reject_code, final_reason as reject_reason
        from v_transfer where final is not null""",
)
oracle(
    "m04_attach_documents",
    f"""select document_id, entity_id, title, file_type, kind as related_entity,
          '/documents/' || lower(kind) || '_' || cast(entity_id as varchar) || '_'
            || replace(title, ' ', '_') || '.' || lower(file_type) as file_path,
          {REPORT_TEXT} as upload_date
        from v_document_reasons where code is null""",
)
oracle(
    "m04_attach_audit",
    audit("'INSERT'", "'DOCUMENTS'", "null", "null",
          """'Added document "' || title || '" to ' || kind || ' ID ' """
          "|| cast(entity_id as varchar)", "'SUCCESS'", "v_document_reasons where code is null")
    + " union all "
    + refused("DOCUMENTS", "null", "attach_documents", "code", "reason",
              "v_document_reasons where code is not null"),
)
oracle(
    "m04_attach_rejected",
    """select document_id, related_entity, entity_id, title, file_type, code as reject_code,
         reason as reject_reason from v_document_reasons where code is not null""",
)
oracle(
    "m05_primary_executors",
    """select x.executor_id, x.will_id, x.full_name, x.email,
         case when c.chosen is null then is_primary when x.executor_id = c.chosen then 'Y'
           else 'N' end as is_primary
       from e_executors x left join v_chosen c on c.will_id = x.will_id""",
)
oracle(
    "m05_primary_audit",
    audit("'DATA_FIX'", "'EXECUTORS'", "will_id",
          "'Several primary executors of will ' || cast(will_id as varchar)",
          "'All reset to non-primary'", "'SUCCESS'", "v_chosen where primaries > 1")
    + " union all "
    + audit("'UPDATE'", "'EXECUTORS'", "chosen",
            "case when old is not null and primaries = 1 then 'Previous primary executor: ID ' "
            "|| cast(old as varchar) else 'No previous primary executor' end",
            "'Set executor ' || cast(chosen as varchar) || ' as primary for will ' "
            "|| cast(will_id as varchar)", "'SUCCESS'", "v_chosen")
    + " union all "
    + refused("EXECUTORS", "executor_id", "set_primary_executors", "code", "reason",
              "v_primary where code is not null"),
)
oracle(
    "m05_primary_rejected",
    """select seq, executor_id, will_id, code as reject_code, reason as reject_reason
       from v_primary where code is not null""",
)
DOOMED = "(select will_id from v_doomed)"
GONE = "(select asset_id from v_gone_assets)"
oracle(
    "m06_delete_wills",
    f"""select will_id, user_id, title, description, status, {stamp('created_at')},
          {stamp('last_updated_at')} from e_wills where will_id not in {DOOMED}""",
)
oracle(
    "m06_delete_assets",
    f"""select asset_id, will_id, name, asset_type, {dbl('value')} from e_assets
        where will_id not in {DOOMED}""",
)
oracle("m06_delete_executors", f"select * from e_executors where will_id not in {DOOMED}")
oracle(
    "m06_delete_shares",
    f"""select mapping_id, asset_id, beneficiary_id, {dbl('share_percent')} from e_shares
        where asset_id not in {GONE}""",
)
oracle(
    "m06_delete_transfers",
    f"""select transfer_id, asset_id, beneficiary_id, {stamp('transfer_date')}, approved_by,
          transfer_status from e_transfers where asset_id not in {GONE}""",
)
oracle(
    "m06_delete_documents",
    f"""select * from e_stored_documents
        where not (related_entity = 'WILL' and entity_id in {DOOMED})
          and not (related_entity = 'ASSET' and entity_id in {GONE})""",
)
oracle(
    "m06_delete_history",
    f"""select will_id, new_status, {stamp('change_date')}, seq from e_changes
        where will_id not in {DOOMED}""",
)
oracle("m06_delete_deleted_counts", 'select will_id, part as "table", n as rows from v_deleted')
oracle(
    "m06_delete_audit",
    audit("'DELETE_ATTEMPT'", "'WILLS'", "will_id", "'Status: ' || old_status",
          "'Related counts - Assets: ' || cast(assets as varchar) || ', Executors: ' "
          "|| cast(executors as varchar) || ', Beneficiaries: ' || cast(shares as varchar) "
          "|| ', Documents: ' || cast(documents as varchar)", "'STARTED'", "v_related")
    + " union all "
    + audit("'DELETE'", "upper(part)", "will_id", "'Deleted ' || cast(n as varchar) || ' rows'",
            "null", "'SUCCESS'", "v_deleted")
    + " union all "
    + audit("'DELETE'", "'WILLS'", "will_id", "'Status before deletion: ' || old_status",
            "'Deleted records: ' || cast(everything as varchar)", "'SUCCESS'", "v_related")
    + " union all "
    + refused("WILLS", "will_id", "delete_wills", "code", "reason",
              "v_deletions where code is not null"),
)
oracle(
    "m06_delete_rejected",
    """select seq, will_id, force, confirm_text, code as reject_code, reason as reject_reason
       from v_deletions where code is not null""",
)
oracle(
    "m07_touch_wills",
    f"""select w.will_id, w.user_id, w.title, w.description, w.status, {stamp('w.created_at')},
          strftime(greatest(w.last_updated_at, coalesce(c.moved, w.last_updated_at)),
            '%Y-%m-%d %H:%M:%S') as last_updated_at
        from e_wills w left join (
          select will_id, max(moved) as moved from (
            select l_orderkey as will_id, l_shipdate as moved from lineitem
            union all select will_id, change_date as moved from e_changes
            union all select a.will_id, s.changed_at from e_share_changes s
              join e_assets a on s.asset_id = a.asset_id) group by will_id) c
          on c.will_id = w.will_id""",
)
SNAPSHOT = """json_object('will_id', {i}, 'title', {t}, 'status', {s})"""
oracle(
    "m08_diff_audit",
    audit(
        "case when o.will_id is null then 'INSERT' when n.will_id is null then 'DELETE' "
        "else 'UPDATE' end",
        "'WILLS'",
        "coalesce(o.will_id, n.will_id)",
        "case when o.will_id is not null then "
        + SNAPSHOT.format(i="o.will_id", t="o.title", s="o.status")
        + " end",
        "case when n.will_id is not null then "
        + SNAPSHOT.format(i="n.will_id", t="n.title", s="n.status")
        + " end",
        "'ALLOWED'",
        """e_wills o full outer join (
             select will_id, title, case when will_id % 7 = 0 then 'Approved' else status end
               as status from e_wills where will_id % 11 <> 0
             union all select will_id + 1000000000000, title, status from e_wills
               where will_id % 13 = 0) n on o.will_id = n.will_id
           where o.will_id is null or n.will_id is null or o.title <> n.title
             or o.status <> n.status""",
    ),
)
oracle(
    "m09_history_history",
    f"""select will_id, seq, old_status, new_status, 'registrar' as changed_by,
          {stamp('change_date')}, 'status change' as reason
        from v_replay where code is null and old_status <> new_status""",
)
REJECTED_CHANGES = f"""select seq, will_id, new_status, {stamp('change_date')}, old_status,
    code as reject_code, case code when -20003 then 'executed will cannot become ' || new_status
      else 'draft will cannot become Executing' end as reject_reason
  from v_replay where code is not null"""
oracle("m09_history_rejected", REJECTED_CHANGES)
oracle(
    "m09_history_state",
    "select will_id, arg_max(status, step) as status from v_replay group by will_id",
)
oracle(
    "m10_add_executors",
    f"""select will_id, full_name, email,
          case when place = 1 and will_id not in (select will_id from e_executors)
            then 'Y' else 'N' end as is_primary
        from (select l_orderkey as will_id, 'Executor ' || cast(l_suppkey as varchar) as full_name,
                {email('l_suppkey')} as email,
                row_number() over (partition by l_orderkey order by {SEQ}) as place
              from lineitem)""",
)
oracle(
    "m11_backfill_roles",
    "select user_id, coalesce(initial_role, 'user') as initial_role from e_users",
)
oracle(
    "m12_update_roles",
    f"""select u.user_id, coalesce(n.new_role, u.initial_role) as initial_role
        from e_users u left join (select {email('s_suppkey * 5')} as email,
            case when s_suppkey % 3 = 0 then 'admin' else 'executor' end as new_role
          from supplier) n on n.email = u.email""",
)

# --- streams ---------------------------------------------------------------------------------

GATE = f"""seq, asset_id, beneficiary_id, {stamp('transfer_date')}, {dbl('share_percent')}"""
oracle("t01_gate_accepted", f"select {GATE} from v_calendar where day_code is null")
oracle(
    "t01_gate_rejected",
    f"""select {GATE}, day_code as reject_code, day_reason as reject_reason
        from v_calendar where day_code is not null""",
)
oracle(
    "t02_activity_per_day",
    """select strftime(timestamp, '%Y-%m-%d') as day, action, count(*) as count
       from e_audit group by 1, 2""",
)
ORACLES["t03_machine_history"] = ORACLES["m09_history_history"]
ORACLES["t03_machine_rejected"] = ORACLES["m09_history_rejected"]
oracle(
    "t04_share_guard",
    f"""select seq, asset_id, beneficiary_id, {dbl('share_percent')}
        from v_assigned where taken""",
)
oracle(
    "t05_repeat_filter",
    """select distinct asset_id, beneficiary_id from e_requests r
       where not exists (select 1 from e_transfers t where t.asset_id = r.asset_id
         and t.beneficiary_id = r.beneficiary_id and t.transfer_status = 'Completed')""",
)
oracle(
    "t06_live_totals",
    """select 'total_users' as name, (select count(*) from e_users) as total
       union all select 'total_wills', (select count(*) from e_wills)
       union all select 'total_assets', (select count(*) from e_assets)
       union all select 'total_transfers', (select count(*) from e_transfers)""",
)
oracle(
    "t06_live_system_totals",
    f"""select name, total, {dbl('amount')} from (
          select 'total_users' as name, (select count(*) from e_users) as total, 0 as amount
          union all select 'total_wills', (select count(*) from e_wills), 0
          union all select 'total_assets', (select count(*) from e_assets), (select coalesce(sum(value), 0) from e_assets)
          union all select 'total_beneficiaries', (select count(*) from e_beneficiaries), 0
          union all select 'total_executors', (select count(*) from e_executors), 0
          union all select 'total_transfers', (select count(*) from e_transfers), 0)""",
)

# Other ways to the same rows.
for _name, _same in {
    "q28_audit_page_indexed": "q28_audit_page",
    "q28_audit_page_facets_by_day": "q28_audit_page_facets",
    "q39_audit_trail_by_day": "q39_audit_trail",
    "q40_audit_action_counts_by_day": "q40_audit_action_counts",
    "p14_text_search_indexed": "p14_text_search",
    "m01_approve_wills_in_parts": "m01_approve_wills",
    "m08_diff_audit_by_digest": "m08_diff_audit",
    "m12_update_roles_in_parts": "m12_update_roles",
}.items():
    ORACLES[_name] = ORACLES[_same]
